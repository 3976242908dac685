"""Canonical climate tables derived from the driver's order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KELVIN = 273.15
UNIT = ["state", "district"]
SERIES = [*UNIT, "model", "scenario"]
ROWS_A_TASK = 500_000  # readings whose groups a task holds: some 300 MB of keys and states


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(spark: SparkSession, sf_dir: str, name: str = "lineitem") -> int:
    """So many tasks that each has ROWS_A_TASK of a table's rows on average, however large it is; the count comes from the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // ROWS_A_TASK))


def scenario_of(date: F.Column, status: F.Column, last_historical: int = 1998) -> F.Column:
    return F.when(F.year(date) <= last_historical, "historical").when(status == "F", "ssp245").otherwise("ssp585")


def observations(spark: SparkSession, sf_dir: str, last_historical: int = 1998) -> DataFrame:
    """One row per reading: state, district, block, cell, model, scenario, date and the raw values. nation and region have a fixed size."""
    places = (
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_name").alias("block"), "s_nationkey")
        .join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_name").alias("district"))), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("state"))), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("cell", "state", "district", "block")
    )
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cell"), F.col("l_returnflag").alias("model"), scenario_of(F.col("l_shipdate"), F.col("l_linestatus"), last_historical).alias("scenario"),
        F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("h"),
    )
    return line.join(places, "cell")


def daily_values() -> list[F.Column]:
    return [
        (F.avg("q") + KELVIN).alias("tas"), (F.max("q") + KELVIN).alias("tasmax"), (F.min("q") + KELVIN).alias("tasmin"),
        (F.avg("h") / 100).alias("hurs"), (F.sum("q") / 10).alias("pr"),
    ]


def panel(spark: SparkSession, sf_dir: str, last_historical: int = 1998, keys: list[str] | None = None) -> DataFrame:
    """daily_panel: one row per unit, model, scenario and day with all variables; temperatures in K, hurs as a fraction, pr in mm/day."""
    seen = observations(spark, sf_dir, last_historical)
    return seen.groupBy(*(keys or SERIES), "date").agg(*daily_values()).withColumn("year", F.year("date"))


#: The same tables for the SQL side.
PANEL_SQL = """obs AS (
  SELECT r_name AS state, n_name AS district, s_name AS block, s_suppkey AS cell, l_returnflag AS model,
    CASE WHEN year(l_shipdate) <= {last} THEN 'historical' WHEN l_linestatus = 'F' THEN 'ssp245' ELSE 'ssp585' END AS scenario,
    CAST(l_shipdate AS DATE) AS date, l_quantity AS q, CAST(round(l_discount * 100) AS INT) AS h
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
panel AS (
  SELECT state, district, model, scenario, date, CAST(year(date) AS INT) AS year, avg(q) + 273.15 AS tas, max(q) + 273.15 AS tasmax, min(q) + 273.15 AS tasmin,
    avg(h) / 100 AS hurs, sum(q) / 10 AS pr
  FROM obs GROUP BY ALL)"""


def panel_sql(last_historical: int = 1998) -> str:
    return PANEL_SQL.format(last=last_historical)
