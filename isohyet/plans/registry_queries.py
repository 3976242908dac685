"""Queries of the whole registry over one stored panel, with SQL for every family of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.plans import registry, upkeep
from isohyet.plans.catalog import query
from isohyet.plans.index_queries import KS, LEAP, MONTHLY, MS, NEAREST, RUNS, WB, doy_cte, doy_exceedance_sql, known_sql, spells_sql, with_doy
from isohyet.plans.registry import METRICS, Metric
from isohyet.sources.adapter import SERIES, UNIT, panel
from isohyet.sources.io import scratch

BASE = (1995, 1998)
SPI_YEARS = (1995, 2000)
UNITS = [*UNIT, "model"]
VARIABLES = ("tasmax", "tasmin", "tas", "hurs", "pr")
PLAIN_SQL = {
    "max": "max({v}) - 273.15",
    "min": "min({v}) - 273.15",
    "mean": "avg({v}) - 273.15",
    "rain_max": "max({v})",
    "count_ge": "CAST(count(*) FILTER ({v} >= {limit}) AS DOUBLE)",
    "count_gt": "CAST(count(*) FILTER ({v} > {limit}) AS DOUBLE)",
    "count_lt": "CAST(count(*) FILTER ({v} < {limit}) AS DOUBLE)",
    "intensity": "coalesce(sum({v}) / nullif(count(*) FILTER ({v} >= {wet}), 0), 0)",
    "wet_total": "coalesce(sum({v}) FILTER ({v} >= {wet}), 0)",
}


def second(runs: str) -> str:
    """The names of a chain of runs changed, for two of them in one statement."""
    return runs[5:].replace("f AS", "f2 AS").replace("i AS", "i2 AS").replace("FROM f)", "FROM f2)").replace("r AS", "r2 AS").replace("FROM i ", "FROM i2 ")


def seasonal(v: str, months: tuple[int, ...]) -> str:
    inside = ", ".join(map(str, months))
    if set(months) != {12, 1, 2}:
        return f"SELECT {KS}, avg({v}) - 273.15 AS value FROM panel WHERE month(date) IN ({inside}) GROUP BY ALL"
    return f"""WITH s AS (SELECT state, district, model, scenario, year(date) + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END AS y, month(date) AS m, {v} AS v FROM panel WHERE month(date) IN ({inside}) AND {LEAP})
SELECT state, district, model, scenario, CAST(y AS INT) AS year, CASE WHEN count(*) FILTER (m = 12) > 0 THEN avg(v) - 273.15 END AS value FROM s GROUP BY ALL HAVING count(*) FILTER (m <> 12) > 0"""


def peak(v: str, q: float, least: int) -> str:
    return f"WITH {doy_cte(v, q)}, {with_doy()}, " + RUNS.format(k=KS, flag=f"{v} >= threshold", src="x")[5:] + f"""
, e AS (SELECT {KS}, island, count(*) AS n, min(pos) AS start_pos, avg({v} - threshold) AS m, max({v}) AS peak FROM i WHERE on_ = 1 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY m DESC, start_pos) AS rn FROM e WHERE n >= {least})
SELECT {KS}, peak - 273.15 AS value FROM (SELECT DISTINCT {KS} FROM x) LEFT JOIN (SELECT * FROM o WHERE rn = 1) USING ({KS})"""


def season_length(v: str, limit: float, least: int) -> str:
    first = RUNS.format(k=KS, flag=f"{v} > {limit}", src="g")[5:].replace("min(pos)", "min(place)")
    last = second(RUNS.format(k=KS, flag=f"{v} < {limit}", src="l")).replace("min(pos)", "min(place)")
    return f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY date) - 1 AS place FROM panel WHERE {LEAP}), {first},
s AS (SELECT {KS}, min(start_pos) AS st FROM r WHERE length >= {least} GROUP BY ALL), l AS (SELECT * FROM g WHERE month(date) >= 7), {last},
n AS (SELECT {KS}, min(start_pos) AS en FROM r2 WHERE length >= {least} GROUP BY ALL), a AS (SELECT {KS}, count(*) AS n FROM g GROUP BY ALL)
SELECT {KS}, CAST(CASE WHEN st IS NULL THEN 0 WHEN en IS NULL THEN n - st ELSE greatest(en - st, 0) END AS DOUBLE) AS value FROM a LEFT JOIN s USING ({KS}) LEFT JOIN n USING ({KS})"""


def rain_runs(column: str, wet: float) -> str:
    runs = RUNS.format(k=KS, flag=f"pr >= {wet}" if column == "cwd" else f"pr < {wet}", src="panel")
    return runs + f", w AS (SELECT {KS}, max(length) AS longest FROM r GROUP BY ALL) SELECT {KS}, CAST(coalesce(longest, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT {KS} FROM panel) LEFT JOIN w USING ({KS})"


def heavy_rain(column: str, wet: float, q: float) -> str:
    value = "hv" if column == "r95p_total" else "CASE WHEN tt > 0 THEN hv / tt * 100 ELSE 0 END"
    return f"""WITH t AS (SELECT {MS}, {NEAREST.format(v='pr', q=q)} AS c FROM panel WHERE scenario = 'historical' AND year BETWEEN {BASE[0]} AND {BASE[1]} AND {LEAP} AND pr >= {wet} GROUP BY ALL),
z AS (SELECT {KS}, any_value(c) AS c, coalesce(sum(pr) FILTER (pr >= {wet} AND pr >= c), 0) AS hv, coalesce(sum(pr) FILTER (pr >= {wet}), 0) AS tt FROM panel LEFT JOIN t USING ({MS}) WHERE {LEAP} GROUP BY {KS})
SELECT {KS}, CASE WHEN c IS NOT NULL THEN {value} END AS value FROM z"""


def wet_bulb(column: str, p: dict) -> str:
    value = {
        "wb_mean": "avg(wb)",
        "wb_max": "max(wb)",
        "wb_days_ge": f"CAST(count(*) FILTER (wb >= {p.get('hot', 30.0)}) AS DOUBLE)",
        "depression_days_le": f"CAST(count(*) FILTER (c - wb <= {p.get('near', 3.0)}) AS DOUBLE)",
    }[column]
    return f"WITH {WB} SELECT {KS}, {value} AS value FROM w GROUP BY ALL"


def spi_sql(column: str, scale: int) -> str:
    value = {
        "spi_mean": "avg(spi)",
        "below_1": "count(*) FILTER (spi < -1)",
        "below_2": "count(*) FILTER (spi < -2)",
        "above_1": "count(*) FILTER (spi > 1)",
        "above_2": "count(*) FILTER (spi > 2)",
    }[column]
    s = ", ".join(SERIES)
    return f"""WITH {MONTHLY}, acc AS (SELECT {s}, month, CASE WHEN count(total) OVER w = {scale} THEN sum(total) OVER w END AS acc FROM monthly WINDOW w AS (PARTITION BY {s} ORDER BY month ROWS BETWEEN {scale - 1} PRECEDING AND CURRENT ROW)),
fit AS (SELECT {MS}, month(month) AS moy, avg(acc) AS m, stddev_pop(acc) AS s FROM acc WHERE scenario = 'historical' AND year(month) BETWEEN {SPI_YEARS[0]} AND {SPI_YEARS[1]} AND acc IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
spi AS (SELECT acc.*, CASE WHEN s = 0 THEN 0 WHEN (acc - m) / nullif(s, 0) IS NOT NULL THEN greatest(least((acc - m) / nullif(s, 0), 4.753424308822899), -4.753424308822899) END AS spi FROM acc LEFT JOIN fit ON acc.state = fit.state AND acc.district = fit.district AND acc.model = fit.model AND month(acc.month) = fit.moy)
SELECT {s}, CAST(year(month) AS INT) AS year, CAST({value} AS DOUBLE) AS value FROM spi GROUP BY ALL HAVING count(spi) >= 9"""


def metric_sql(m: Metric) -> str:
    """One metric over the tables of the panel."""
    p, column = m.params, m.params.get("column")
    if m.kind in PLAIN_SQL:
        return f"SELECT {KS}, {PLAIN_SQL[m.kind].format(v=m.var, **p)} AS value FROM panel GROUP BY ALL"
    if m.kind == "doy_exceedance":
        return doy_exceedance_sql(m.var, p["q"], p.get("above", True), "value")
    if m.kind == "spells":
        value = known_sql("events" if column == "events" else "total")
        return f"{spells_sql(m.var, p['q'], p.get('above', True), p['least'])} SELECT {KS}, {value} AS value FROM a LEFT JOIN n USING ({KS}) LEFT JOIN b USING ({MS})"
    if m.kind == "range":
        value = "avg(tasmax - tasmin)" if column == "daily_range" else "max(tasmax) - min(tasmin)"
        return f"SELECT {KS}, {value} AS value FROM panel GROUP BY ALL"
    if m.kind == "rx5day":
        return f"WITH q AS (SELECT *, CASE WHEN count(pr) OVER w = 5 THEN sum(pr) OVER w END AS s5 FROM panel WINDOW w AS (PARTITION BY {KS} ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT {KS}, max(s5) AS value FROM q WHERE s5 IS NOT NULL GROUP BY ALL"
    made = {
        "wet_bulb": lambda: wet_bulb(column, p),
        "heatwave_peak": lambda: peak(m.var, p["q"], p["least"]),
        "seasonal_mean": lambda: seasonal(m.var, p["months"]),
        "growing_season": lambda: season_length(m.var, p["limit"], p["least"]),
        "r95p": lambda: heavy_rain(column, p["wet"], p["q"]),
        "rain_runs": lambda: rain_runs(column, p["wet"]),
        "spi": lambda: spi_sql(column, p["scale"]),
    }
    return made[m.kind]()


def all_sql(metrics: list[Metric]) -> str:
    return "WITH " + ", ".join(f"m{i} AS ({metric_sql(m)})" for i, m in enumerate(metrics)) + " " + " UNION ALL ".join(f"SELECT '{m.slug}' AS slug, {KS}, round(value, 6) AS value FROM m{i}" for i, m in enumerate(metrics))


def stored_panel(spark, d, last=1998):
    """The panel as a written table: every builder reads it, none makes it again."""
    path = scratch(spark, "panel")
    panel(spark, d, last).write.parquet(path)
    return spark.read.parquet(path)


AGGREGATES = [m for m in METRICS if m.kind in registry.PLAIN]
SPI = [m for m in METRICS if m.kind == "spi"]
OTHERS = [m for m in METRICS if m not in AGGREGATES and m not in SPI]


@query(all_sql(AGGREGATES), last=1998)
def registry_yearly_plain(spark, d):
    """All metrics that are one aggregate of a year: one grouped pass."""
    return registry.build(panel(spark, d), UNITS, [m.slug for m in AGGREGATES])


@query(all_sql(OTHERS), last=1998)
def registry_yearly_with_baseline(spark, d):
    """All metrics with a baseline, spells, seasons, ranges or rolling sums."""
    return registry.build(stored_panel(spark, d), UNITS, [m.slug for m in OTHERS], BASE)


@query(all_sql(SPI), last=2000)
def registry_yearly_spi(spark, d):
    """All metrics of the precipitation index: a fit takes five historical years, so history lasts until 2000 here."""
    return registry.build(stored_panel(spark, d, 2000), UNITS, [m.slug for m in SPI], SPI_YEARS)


THEMES = "(VALUES " + ", ".join(f"('{b}', {i}, '{s}')" for b, slugs in registry.BUNDLES.items() for i, s in enumerate(slugs)) + ") t(bundle, position, slug)"
MEASURED = " UNION ALL ".join(f"SELECT '{m.slug}' AS slug WHERE (SELECT count({m.var}) FROM panel) > 0" for m in METRICS)


@query(f"SELECT slug, count(DISTINCT bundle) AS bundles, CAST(min(position) AS INT) AS position FROM {THEMES} WHERE slug IN (SELECT slug FROM ({MEASURED})) GROUP BY ALL", last=1998)
def bundle_expand(spark, d):
    """Themes to their metrics, without repeats, for the variables that the panel has values of."""
    held = panel(spark, d).agg(*[F.count(v).alias(v) for v in VARIABLES]).unpivot([], list(VARIABLES), "var", "n").where("n > 0")
    known = registry.metric_dim(spark).join(held, "var", "left_semi").select("slug")
    return registry.bundle_dim(spark).join(known, "slug", "left_semi").groupBy("slug").agg(F.count_distinct("bundle").alias("bundles"), F.min("position").alias("position"))


STALE = ["txx_annual_max", "tx90p_hot_days_pct", "prcptot_annual_total"]


@query(f"""SELECT 'txx_annual_max' AS slug, {KS}, round(max(tasmax) - 273.15, 6) AS value FROM panel GROUP BY ALL
UNION ALL SELECT 'prcptot_annual_total', {KS}, round(coalesce(sum(pr) FILTER (pr >= 1), 0), 6) FROM panel GROUP BY ALL
UNION ALL SELECT 'tx90p_hot_days_pct', {KS}, value FROM ({doy_exceedance_sql("tasmax", 0.9, True, "value")})""", last=1998)
def refresh_stale_years(spark, d):
    """The yearly table, first written from days of which a baseline year of one model was other, and without a year of another; then brought up to date."""
    root, path = scratch(spark, "kept-up"), scratch(spark, "days")
    panel(spark, d).write.parquet(path)
    days = spark.read.parquet(path)
    other = (F.col("model") == "A") & (F.col("scenario") == "historical") & (F.col("year") == 1996)
    before = days.where("NOT (model = 'N' AND year = 2000)").withColumns({v: F.when(other, F.col(v) * 1.01).otherwise(F.col(v)) for v in ("tasmax", "pr")})
    upkeep.refresh_yearly(before, UNITS, root, STALE, BASE)
    upkeep.refresh_yearly(days, UNITS, root, STALE, BASE)
    return upkeep.read_yearly(spark, root, registry.build(days, UNITS, STALE, BASE).schema)
