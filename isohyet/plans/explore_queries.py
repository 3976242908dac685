"""Rankings, maps, profiles and trends for every metric, scenario and period at once, on the merged boundary table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isohyet.functions import risk
from isohyet.operators import matching, ranking
from isohyet.operators.order_stats import written
from isohyet.plans.catalog import query
from isohyet.plans.table_queries import MASTER, RISK, YEARLY, master, yearly
from isohyet.sources.adapter import UNIT, table

AXES = ["slug", "scenario", "period"]
BASELINES = ("1995-1998", "1996-1998")  # periods preferred as the baseline, in this order
BASE_SQL = """bp AS (SELECT slug, arg_min(period, CASE period WHEN '1995-1998' THEN '0' WHEN '1996-1998' THEN '1' ELSE '2' || period END) AS period FROM master WHERE scenario = 'historical' GROUP BY ALL),
bas AS (SELECT slug, state, district, mean AS baseline FROM master JOIN bp USING (slug, period) WHERE scenario = 'historical'),
axes AS (SELECT DISTINCT slug, scenario, period FROM master),
bounds AS (SELECT r_name AS state, n_name AS district, 0.5 * (1.0 + (n_nationkey % 3) * 0.5) ** 2 AS area FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN (SELECT state FROM master)),
al AS (SELECT slug, scenario, period, state, district, area, round(mean, 9) AS value, round(median, 9) AS median, baseline, round(mean - baseline, 9) AS delta FROM axes CROSS JOIN bounds LEFT JOIN master USING (slug, scenario, period, state, district) LEFT JOIN bas USING (slug, state, district))"""
ALL = f"{MASTER}, {BASE_SQL}"
GROUP = "slug, scenario, period, state"


def everything(spark, d):
    """slug, scenario, period, state, district, area, value, median, baseline, delta: every unit of the boundaries for every column of the master; units without a value keep their row."""
    m = written(master(spark, d).select(*AXES, *UNIT, "mean", "median"), "master")
    preferred = ranking.find_baseline_period(m, ["slug"], BASELINES).withColumnRenamed("baseline_period", "period")
    base = m.where("scenario = 'historical'").join(preferred, ["slug", "period"]).select("slug", *UNIT, F.col("mean").alias("baseline"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    width = 1 + F.col("n_nationkey") % 3 * 0.5
    bounds = n.select(F.initcap("n_name").alias("district_name"), F.lower("r_name").alias("state_name"), F.col("n_name").alias("shown"), F.col("r_name").alias("shown_state"), (width * width / 2).alias("area"))
    kept = matching.merge_master(bounds, m.select(*UNIT).distinct(), "state_name", "district_name")
    # the master's columns are few names: each boundary gets a row for each of them
    axes = m.agg(F.collect_set(F.struct(*AXES)).alias("axes"))
    grid = kept.select(F.col("shown_state").alias("state"), F.col("shown").alias("district"), "area").crossJoin(F.broadcast(axes)).select("*", F.explode("axes").alias("axis")).select("state", "district", "area", "axis.*")
    met = grid.join(m, [*AXES, *UNIT], "left").join(base, ["slug", *UNIT], "left")
    return met.select(*AXES, *UNIT, "area", ranking.tied("mean").alias("value"), ranking.tied("median").alias("median"), "baseline", F.round(F.col("mean") - F.col("baseline"), ranking.PLACES).alias("delta"))


@query(f"""WITH {ALL}, r AS (SELECT *, rank() OVER (PARTITION BY {GROUP}, value IS NOT NULL ORDER BY value DESC) AS rv, (rank() OVER (PARTITION BY {GROUP}, value IS NOT NULL ORDER BY value) + (count(*) OVER (PARTITION BY {GROUP}, value) - 1) / 2) / count(value) OVER (PARTITION BY {GROUP}) * 100 AS pc,
rank() OVER (PARTITION BY {GROUP}, delta IS NOT NULL ORDER BY delta DESC) AS rd FROM al)
SELECT {GROUP}, district, round(value, 6) AS value, round(baseline, 6) AS baseline, round(delta, 6) AS delta, CASE WHEN value IS NOT NULL THEN CAST(rv AS INT) END AS rank_value, CASE WHEN value IS NOT NULL THEN round(pc, 6) END AS percentile, CASE WHEN delta IS NOT NULL THEN CAST(rd AS INT) END AS rank_delta, {RISK.format(p='(CASE WHEN value IS NOT NULL THEN pc END)')} AS risk_class FROM r""", last=1998)
def rankings_all(spark, d):
    r = ranking.rankings_table(everything(spark, d), [*AXES, "state"])
    return r.select(*AXES, *UNIT, "value", "baseline", "delta", F.col("rank_value").cast("int").alias("rank_value"), "percentile", F.col("rank_delta").cast("int").alias("rank_delta"), risk.risk_class(F.col("percentile")).alias("risk_class"))


@query(f"""WITH {ALL}, g AS (SELECT slug, scenario, period, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM al GROUP BY ALL),
e AS (SELECT slug, scenario, period, CASE WHEN lo = hi THEN lo - greatest(abs(lo) * 0.1, 1) ELSE lo END AS vmin, CASE WHEN lo = hi THEN hi + greatest(abs(lo) * 0.1, 1) ELSE hi END AS vmax FROM g),
r AS (SELECT *, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY {GROUP}, value IS NOT NULL ORDER BY value DESC) END AS rk, CASE WHEN value IS NOT NULL THEN CAST(count(value) OVER (PARTITION BY {GROUP} ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / count(value) OVER (PARTITION BY {GROUP}) * 100 END AS pc FROM al)
SELECT {GROUP}, district, round(value, 6) AS value, CAST(rk AS INT) AS rank, round(pc, 6) AS percentile, {RISK.format(p='pc')} AS risk_class, CAST(least(greatest(floor((value - vmin) / ((vmax - vmin) / 15)), 0), 14) AS INT) AS bin, round(vmin, 6) AS vmin, round(vmax, 6) AS vmax FROM r JOIN e USING (slug, scenario, period)""", last=1998)
def map_enrichment_all(spark, d):
    """Rank, percentile, risk class and colour bin of every unit, with the range of its map."""
    rows = written(everything(spark, d), "everything")
    ranges = ranking.robust_range(rows, AXES).select(*AXES, "vmin", "vmax")
    r = ranking.rank_in_group(rows, [*AXES, "state"]).join(ranges, AXES)
    return r.select(*AXES, *UNIT, "value", F.col("rank").cast("int").alias("rank"), "percentile", risk.risk_class(F.col("percentile")).alias("risk_class"), risk.bin_values(F.col("value"), F.col("vmin"), F.col("vmax")).alias("bin"), "vmin", "vmax")


def _position_sql(column: str) -> str:
    part = f"PARTITION BY {GROUP}, {column} IS NOT NULL"
    return f"CASE WHEN {column} IS NOT NULL THEN rank() OVER ({part} ORDER BY {column} DESC) END"


@query(f"""WITH {ALL} SELECT {GROUP}, district, round(value, 6) AS current, round(median, 6) AS median, round(baseline, 6) AS baseline, round(delta, 6) AS delta, {_position_sql('value')} AS rank_by_mean, {_position_sql('median')} AS rank_by_median, count(value) OVER (PARTITION BY {GROUP}) AS n,
round(count(value) OVER (PARTITION BY {GROUP} ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(value) OVER (PARTITION BY {GROUP}) * 100, 6) AS percentile FROM al""", last=1998)
def unit_profile_all(spark, d):
    """A unit's value and place in its state, by the mean of the models and by their median."""
    group = [*AXES, "state"]
    r = ranking.position_stats(everything(spark, d), group)
    r = ranking.position_stats(r.withColumnsRenamed({"position": "rank_by_mean", "n": "n_mean", "position_percentile": "percentile"}), group, "median")
    return r.select(*AXES, *UNIT, F.col("value").alias("current"), "median", "baseline", "delta", "rank_by_mean", F.col("position").alias("rank_by_median"), F.col("n_mean").alias("n"), "percentile")


@query(f"""WITH {ALL}, s AS (SELECT slug, scenario, period, state, sum(value * area) FILTER (value IS NOT NULL) / sum(area) FILTER (value IS NOT NULL) AS cur, sum(baseline * area) FILTER (baseline IS NOT NULL) / sum(area) FILTER (baseline IS NOT NULL) AS bas FROM al GROUP BY ALL)
SELECT {GROUP}, round(cur, 6) AS current, round(bas, 6) AS baseline, round(cur - bas, 6) AS delta, CAST(rank() OVER (PARTITION BY slug, scenario, period ORDER BY round(cur, 9) DESC) AS INT) AS position, count(*) OVER (PARTITION BY slug, scenario, period) AS n FROM s WHERE cur IS NOT NULL""", last=1998)
def state_profile_all(spark, d):
    """Area-weighted values of every state and its place among all states, metric by metric."""
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("area"))
    mean = lambda c: F.sum(F.col(c) * F.col("area")) / F.sum(has(c))
    s = everything(spark, d).groupBy(*AXES, "state").agg(mean("value").alias("current"), mean("baseline").alias("baseline")).where("current is not null")
    placed = ranking.position_stats(s, AXES, "current")
    return placed.select(*AXES, "state", "current", "baseline", (F.col("current") - F.col("baseline")).alias("delta"), F.col("position").cast("int").alias("position"), "n")


CHOICES = (("mean", 1995, 1998), ("median", 1995, 1998), ("median", 1999, 2001))


def trend_series(series, statistic: str, first: int, last: int, keys: list[str]):
    """series with value (the mean or the median, whichever is asked for, the other where it is missing) and delta, its difference from the mean of the years first to last."""
    value = F.round(F.coalesce(statistic, "median" if statistic == "mean" else "mean"), ranking.PLACES)
    of = F.avg(F.when(F.col("year").between(first, last), F.col("value"))).over(Window.partitionBy(*keys))
    return series.withColumn("value", value).withColumn("delta", F.col("value") - of)


@query(f"WITH {YEARLY}, e AS (SELECT slug, state, district, year, avg(value) AS mean, median(value) AS median FROM yearly GROUP BY ALL), c(statistic, y0, y1) AS (VALUES " + ", ".join(f"('{s}', {a}, {b})" for s, a, b in CHOICES) + """),
v AS (SELECT e.*, statistic, y0, y1, CASE WHEN statistic = 'mean' THEN mean ELSE median END AS value FROM e, c)
SELECT statistic, CAST(y0 AS INT) AS first_year, slug, state, district, year, round(round(value, 9), 6) AS value, round(value - avg(value) FILTER (year BETWEEN y0 AND y1) OVER (PARTITION BY statistic, y0, slug, state, district), 6) AS delta FROM v""", last=1998)
def trend_series_choices(spark, d):
    """Trends by mean or median against a chosen span of years."""
    keys = ["slug", *UNIT]
    e = written(yearly(spark, d).groupBy(*keys, "year").agg(F.avg("value").alias("mean"), F.median("value").alias("median")), "trends")
    parts = [trend_series(e, s, a, b, keys).select(F.lit(s).alias("statistic"), F.lit(a).alias("first_year"), *keys, "year", "value", "delta") for s, a, b in CHOICES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
