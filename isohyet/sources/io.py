"""Reading and writing of the engine's tables through Spark's own sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of coordinate columns. Fixed values.
RENAMES = {"latitude": "lat", "y": "lat", "longitude": "lon", "x": "lon", "valid_time": "time"}


#: The folders that scratch() gave out.
GIVEN: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder for a written table under the session's shared folder (spark.checkpoint.dir, or the checkpoint directory that was set).

    Only a session on one machine may go without one: its own temporary folder is
    shared by all its tasks. On a cluster that would lose rows, so it is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-isohyet-")
        context.setCheckpointDir(base)
    GIVEN.append(f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return GIVEN[-1]


def remove_scratch(spark: SparkSession) -> int:
    """Delete all folders that scratch() gave out in this process, once nothing that reads them is needed any more; how many there were."""
    n = 0
    while GIVEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(GIVEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def canonical_coordinates(grid: DataFrame) -> DataFrame:
    return grid.withColumnsRenamed({c: RENAMES[c.lower()] for c in grid.columns if c.lower() in RENAMES and RENAMES[c.lower()] not in grid.columns})


def scan_grid_daily(spark: SparkSession, path: str, variables: list[str], scenarios: list[str]) -> DataFrame:
    """The long grid table of some variables and scenarios; partitions that don't match are never listed. NaN becomes null."""
    grid = canonical_coordinates(spark.read.parquet(path)).where(F.col("var").isin(variables) & F.col("scenario").isin(scenarios))
    return grid.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def scan_csv_table(spark: SparkSession, path: str, schema: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """A CSV table with a header under a given schema, in the first of the encodings that all its text fits; fields that don't fit their type are null.

    The last encoding is taken without a look: ISO-8859-1 fits any bytes.
    """
    read = lambda e: spark.read.csv(path, header=True, schema=schema, encoding=e, mode="PERMISSIVE", enforceSchema=False)
    for encoding in encodings[:-1]:
        rows = read(encoding)
        texts = [c for c, t in rows.dtypes if t == "string"]
        # bytes that don't fit are read as the replacement character
        if not texts or rows.where(F.concat_ws("", *texts).contains("\ufffd")).isEmpty():
            return rows
    return read(encodings[-1])


def scan_table_filtered(spark: SparkSession, path: str, columns: list[str] | None = None, filters: list[tuple[str, str, object]] | dict | None = None) -> DataFrame:
    """Columns of a partitioned Parquet table where columns equal values, all of them; both reach the scan. Any operator but == is an error."""
    rows = spark.read.parquet(path)
    for column, op, value in [(c, "==", v) for c, v in filters.items()] if isinstance(filters, dict) else filters or []:
        if op not in ("=", "=="):
            raise ValueError(f"only equality filters are supported, not {op}")
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.select(*columns) if columns else rows


def discover_models(grid: DataFrame) -> DataFrame:
    return grid.select("model").distinct()


def required_years(grid: DataFrame, variables: list[str], year: Column | None = None) -> DataFrame:
    """(model, scenario, year) for which every variable is there."""
    y = year if year is not None else F.year("date")
    return grid.where(F.col("var").isin(variables)).groupBy("model", "scenario", y.alias("year")).agg(F.count_distinct("var").alias("n")).where(F.col("n") == len(variables)).drop("n")


def stage_reanalysis(rows: DataFrame, west: float, south: float, east: float, north: float, order: str, missing: float = -999.0) -> DataFrame:
    """Daily rain in mm within a box, missing values as null, one row for each time and cell: the first value there is, by the order column."""
    from isohyet.functions.units import pr_to_mm_day

    inside = canonical_coordinates(rows).where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    value = pr_to_mm_day(F.nullif(F.col("value"), F.lit(missing)), F.col("units"), staging=True)
    first = F.min_by(value, F.when(value.isNotNull(), F.col(order)))
    return inside.groupBy("time", "lat", "lon").agg(first.alias("value")).withColumn("year", F.year("time"))


def infer_celsius(rows: DataFrame, source: str, date: str = "date", value: str = "value", units: str = "units") -> DataFrame:
    """Temperatures in °C: by units, else Kelvin where the median of the source's first ten dates is above 100."""
    first = rows.select(source, date).distinct().groupBy(source).agg(F.sort_array(F.collect_set(date)).alias("d")).select(source, F.slice("d", 1, 10).alias("d"))
    probe = rows.join(first, source).where(F.array_contains("d", F.col(date))).groupBy(source).agg(F.median(value).alias("m"))
    u = F.lower(F.trim(units))
    kelvin = F.when(u.isin("k", "kelvin"), True).when(u.isin("c", "°c", "degc", "celsius"), False).otherwise(F.col("m") > 100)
    return rows.join(probe, source, "left").withColumn(value, F.when(kelvin, F.col(value) - 273.15).otherwise(F.col(value))).drop("m")


def write_partitioned(rows: DataFrame, path: str, *columns: str) -> None:
    """A table by partition columns: unit outputs, ensembles, state summaries, staged years, monthly SPI. Small partitions are one file each, large ones are written by several tasks."""
    rows.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def intersect_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, each once: made distinct before the join that Spark makes of it, so equal rows are neither shuffled nor sorted."""
    return a.distinct().intersect(b.distinct())


def missing_from(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """What a table with provenance columns doesn't hold yet."""
    return wanted.join(held.select(*keys).distinct(), keys, "left_anti")


def feature_collections(rows: DataFrame, state: str, geometry: str, properties: list[str], key: str) -> DataFrame:
    """One FeatureCollection text per state, features in order of the key, nulls kept."""
    feature = F.struct(F.lit("Feature").alias("type"), F.col(key).alias("id"), F.col(geometry).alias("geometry"), F.struct(*properties).alias("properties"))
    packed = rows.groupBy(state).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), feature.alias("f")))).alias("fs"))
    return packed.select(state, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["f"]).alias("features")), {"ignoreNullFields": "false"}).alias("geojson"))
