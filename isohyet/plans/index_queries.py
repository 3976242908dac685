"""Queries of the yearly indices over the panel of units, models, scenarios and days."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.operators import indices, runs, thresholds
from isohyet.plans.catalog import query
from isohyet.sources.adapter import SERIES, UNIT, panel

K = [*SERIES, "year"]
M = [*UNIT, "model"]
KS = "state, district, model, scenario, year"
MS = "state, district, model"
BASE = (1995, 1998)
LEAP = "NOT (month(date) = 2 AND day(date) = 29)"
DOY = "CASE WHEN NOT (month(date) = 2 AND day(date) = 29) THEN dayofyear(date) - CASE WHEN month(date) > 2 AND ((year(date) % 4 = 0 AND year(date) % 100 <> 0) OR year(date) % 400 = 0) THEN 1 ELSE 0 END END"


def p(spark, d):
    return panel(spark, d)


@query(f"SELECT {KS}, CAST(count(*) FILTER (tasmax > 303.15) AS DOUBLE) AS above, CAST(count(*) FILTER (tasmax >= 303.15) AS DOUBLE) AS at_least, CAST(count(*) FILTER (tasmin < 283.15) AS DOUBLE) AS below FROM panel GROUP BY ALL", last=1998)
def count_days(spark, d):
    days = p(spark, d)
    hot = indices.threshold_counts(days, K, "tasmax", {"above": ("gt", 303.15), "at_least": ("ge", 303.15)})
    return hot.join(indices.threshold_counts(days, K, "tasmin", {"below": ("lt", 283.15)}), K)


@query(f"SELECT {KS}, round(avg(tas) - 273.15, 6) AS annual_mean, round(max(tas) - 273.15, 6) AS annual_max, round(min(tas) - 273.15, 6) AS annual_min FROM panel GROUP BY ALL", last=1998)
def annual_mean_max_min(spark, d):
    return indices.annual_stats(p(spark, d), K, "tas")


@query(f"SELECT {KS}, round(avg(tas) - 273.15, 6) AS seasonal_mean FROM panel WHERE month(date) IN (6, 7, 8, 9) GROUP BY ALL", last=1998)
def seasonal_mean(spark, d):
    return indices.seasonal_mean(p(spark, d), K, "tas", (6, 7, 8, 9))


@query(f"""WITH s AS (SELECT state, district, model, scenario, year(date) + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END AS y, month(date) AS m, tas FROM panel WHERE month(date) IN (12, 1, 2) AND {LEAP})
SELECT state, district, model, scenario, CAST(y AS INT) AS year, CASE WHEN count(*) FILTER (m = 12) > 0 THEN round(avg(tas) - 273.15, 6) END AS seasonal_mean FROM s GROUP BY ALL HAVING count(*) FILTER (m <> 12) > 0""", last=1998)
def seasonal_mean_djf(spark, d):
    return indices.seasonal_mean(p(spark, d), K, "tas", (12, 1, 2))


RUNS = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY date) AS pos, CASE WHEN {flag} THEN 1 ELSE 0 END AS on_ FROM {src}),
i AS (SELECT *, sum(1 - on_) OVER (PARTITION BY {k} ORDER BY pos) AS island FROM f),
r AS (SELECT {k}, island, count(*) AS length, min(pos) AS start_pos FROM i WHERE on_ = 1 GROUP BY ALL)"""


@query(RUNS.format(k=KS, flag="tasmax > 298.15", src="panel") + f"""
SELECT {KS}, (SELECT 1) * coalesce(any_value(n.longest), 0) AS longest, coalesce(any_value(n.total), 0) AS days_in_runs, coalesce(any_value(n.events), 0) AS events, count(*) AS n_days
FROM panel LEFT JOIN (SELECT {KS}, max(length) AS longest, CAST(sum(length) AS BIGINT) AS total, count(*) AS events FROM r WHERE length >= 3 GROUP BY ALL) n USING ({KS}) GROUP BY ALL""", last=1998)
def run_length(spark, d):
    return runs.run_stats(p(spark, d), K, F.col("tasmax") > 298.15, 3)


@query(RUNS.format(k=KS, flag="tasmax > 298.15", src="panel") + f", q AS (SELECT {KS}, count(*) AS events FROM r WHERE length >= 2 GROUP BY ALL) SELECT * FROM q", last=1998)
def count_events(spark, d):
    return runs.run_lengths(p(spark, d), K, F.col("tasmax") > 298.15).where("length >= 2").groupBy(*K).agg(F.count(F.lit(1)).alias("events"))


@query(RUNS.format(k=KS, flag="tasmax > 293.15", src="panel") + f" SELECT {KS}, CAST(start_pos - 1 AS INT) AS first_position, array_to_string(list_transform(range(start_pos - 1, start_pos - 1 + length), lambda x: CAST(x AS VARCHAR)), ',') AS positions FROM r WHERE length >= 4", last=1998)
def spell_list(spark, d):
    s = runs.spell_list(p(spark, d), K, F.col("tasmax") > 293.15, 4)
    return s.select(*K, F.col("begin").alias("first_position"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(RUNS.format(k=KS, flag="tasmax >= 303.15", src="panel") + f"""
, e AS (SELECT {KS}, island, count(*) AS n, min(pos) AS start_pos, avg(tasmax - 303.15) AS m, max(tasmax) AS peak FROM i WHERE on_ = 1 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY m DESC, start_pos) AS rn FROM e WHERE n >= 3)
SELECT {KS}, round(m, 6) AS magnitude, round(peak, 6) AS peak FROM o WHERE rn = 1""", last=1998)
def hottest_spell(spark, d):
    return runs.hottest_spell(p(spark, d).withColumn("limit", F.lit(303.15)), K, "tasmax", "limit", 3)


@query(f"SELECT {KS}, date, CASE WHEN count(pr) OVER w = 5 THEN round(sum(pr) OVER w, 6) END AS sum5 FROM panel WINDOW w AS (PARTITION BY {KS} ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", last=1998)
def rolling_sum_days(spark, d):
    return runs.rolling_sum(p(spark, d), K, "pr", 5, "date", "sum5").select(*K, "date", "sum5")


MONTHLY = "monthly AS (SELECT state, district, model, scenario, CAST(date_trunc('month', date) AS DATE) AS month, sum(pr) AS total FROM panel GROUP BY ALL)"


@query(f"WITH {MONTHLY} SELECT state, district, model, scenario, month, CASE WHEN count(total) OVER w = 3 THEN round(sum(total) OVER w, 6) END AS sum3 FROM monthly WINDOW w AS (PARTITION BY state, district, model, scenario ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", last=1998)
def rolling_sum_months(spark, d):
    return runs.rolling_sum(monthly(spark, d), SERIES, "total", 3, "month", "sum3").select(*SERIES, "month", "sum3")


def monthly(spark, d, last=1998):
    return panel(spark, d, last).groupBy(*SERIES, F.trunc("date", "MM").alias("month")).agg(F.sum("pr").alias("total"))


@query(f"WITH {MONTHLY} SELECT state, district, model, scenario, month, round(total, 6) AS total FROM monthly", last=1998)
def monthly_totals(spark, d):
    return monthly(spark, d)


@query(f"WITH c AS (SELECT {KS}, quantile_cont(tasmax, 0.9) AS hi, quantile_cont(tasmin, 0.1) AS lo FROM panel GROUP BY ALL) SELECT {KS}, round(avg(CASE WHEN tasmax > hi THEN 1 ELSE 0 END) * 100, 6) AS above, round(avg(CASE WHEN tasmin < lo THEN 1 ELSE 0 END) * 100, 6) AS below FROM panel JOIN c USING ({KS}) GROUP BY ALL", last=1998)
def percentile_days(spark, d):
    days = p(spark, d)
    hi = indices.percentile_days(days, K, "tasmax", 0.9).withColumnRenamed("pct_days", "above")
    return hi.join(indices.percentile_days(days, K, "tasmin", 0.1, above=False).withColumnRenamed("pct_days", "below"), K)


NEAREST = "list_sort(list({v}))[CAST(round_even((count({v}) - 1) * {q}, 0) AS INT) + 1]"


def doy_cte(v: str, q: float, name: str = "t") -> str:
    """The thresholds of the day of the year."""
    return f"""{name} AS (SELECT {MS}, (d0 - 1 + o + 365) % 365 + 1 AS doy, {NEAREST.format(v=v, q=q)} AS threshold
  FROM (SELECT *, {DOY} AS d0 FROM panel WHERE scenario = 'historical' AND year BETWEEN 1995 AND 1998 AND {LEAP}), (SELECT unnest([-2, -1, 0, 1, 2]) AS o) GROUP BY ALL)"""


def with_doy(name: str = "t") -> str:
    return f"x AS (SELECT panel.*, {name}.threshold FROM (SELECT *, {DOY} AS doy FROM panel WHERE {LEAP}) panel LEFT JOIN {name} USING (state, district, model, doy))"


@query(f"WITH {doy_cte('tasmax', 0.9)} SELECT {MS}, CAST(doy AS INT) AS doy, round(threshold, 6) AS threshold FROM t", last=1998)
def doy_window_percentile(spark, d):
    days = p(spark, d)
    return thresholds.doy_thresholds(indices.baseline_of(days, M, *BASE), M, "tasmax", 0.9).select(*M, F.col("doy").cast("int").alias("doy"), "threshold")


@query(f"WITH {doy_cte('tasmax', 0.9)} SELECT {MS}, CAST(d2 AS INT) AS doy, CASE WHEN count(threshold) = 3 THEN round(avg(threshold), 6) END AS threshold FROM (SELECT *, (doy - 1 + o + 365) % 365 + 1 AS d2 FROM t, (SELECT unnest([-1, 0, 1]) AS o)) GROUP BY ALL", last=1998)
def doy_smooth(spark, d):
    t = thresholds.doy_thresholds(indices.baseline_of(p(spark, d), M, *BASE), M, "tasmax", 0.9)
    return thresholds.doy_smooth(t, M).select(*M, F.col("doy").cast("int").alias("doy"), "threshold")


@query(f"SELECT {MS}, CAST(d0 AS INT) AS doy, round(greatest(avg(tasmax) + 5, 313.15), 6) AS threshold FROM (SELECT *, {DOY} AS d0 FROM panel WHERE scenario = 'historical' AND year BETWEEN 1995 AND 1998 AND {LEAP}) GROUP BY ALL", last=1998)
def doy_baseline_mean(spark, d):
    return thresholds.doy_means(indices.baseline_of(p(spark, d), M, *BASE), M, "tasmax").select(*M, F.col("doy").cast("int").alias("doy"), "threshold")


@query(f"WITH {doy_cte('tasmax', 0.9)}, {with_doy()} SELECT {KS}, date, round(threshold, 6) AS threshold FROM x", last=1998)
def attach_doy_threshold(spark, d):
    days = p(spark, d)
    t = thresholds.doy_thresholds(indices.baseline_of(days, M, *BASE), M, "tasmax", 0.9)
    return thresholds.attach(days, t, M).select(*K, "date", "threshold")


def doy_exceedance_sql(v: str, q: float, above: bool, name: str = "pct_days") -> str:
    op = ">=" if above else "<="
    return f"WITH {doy_cte(v, q)}, {with_doy()} SELECT {KS}, round(avg(CASE WHEN {v} {op} threshold THEN 1 ELSE 0 END) * 100, 6) AS {name} FROM x GROUP BY ALL"


for _name, _v, _q, _above in (("tx90p_etccdi", "tasmax", 0.9, True), ("tn90p_etccdi", "tasmin", 0.9, True), ("tx10p_etccdi", "tasmax", 0.1, False), ("tn10p_etccdi", "tasmin", 0.1, False)):
    query(doy_exceedance_sql(_v, _q, _above), name=_name, last=1998)(lambda spark, d, v=_v, q=_q, above=_above: indices.doy_exceedance(p(spark, d), M, v, q, BASE, above))


def spells_sql(v: str, q: float, above: bool, least: int) -> str:
    head = RUNS.format(k=KS, flag=f"{v} {'>=' if above else '<='} threshold", src="x")
    return f"WITH {doy_cte(v, q)}, {with_doy()}, {head[5:]}, n AS (SELECT {KS}, max(length) AS longest, sum(length) AS total, count(*) AS events FROM r WHERE length >= {least} GROUP BY ALL), a AS (SELECT {KS}, count(*) AS n_days FROM x GROUP BY ALL), b AS (SELECT DISTINCT {MS}, 1 AS one FROM t)"


def _spell_query(name, v, q, above, least, cols, sql_cols):
    query(spells_sql(v, q, above, least) + f" SELECT {KS}, {sql_cols} FROM a LEFT JOIN n USING ({KS}) LEFT JOIN b USING ({MS})", name=name, last=1998)(
        lambda spark, d: indices.spell_days(p(spark, d), M, v, q, BASE, above, least).select(*K, *cols(F))
    )


def known_sql(x: str) -> str:
    return f"CASE WHEN one = 1 THEN CAST(coalesce({x}, 0) AS DOUBLE) END"


_spell_query("warm_spell_days", "tasmax", 0.9, True, 2, lambda F: ["days_in_runs"], f"{known_sql('total')} AS days_in_runs")
_spell_query("cold_spell_days", "tasmin", 0.1, False, 2, lambda F: ["days_in_runs"], f"{known_sql('total')} AS days_in_runs")
_spell_query("heatwave_frequency_pct", "tasmax", 0.9, True, 2, lambda F: ["days_in_runs", "longest", "events"], f"{known_sql('total')} AS days_in_runs, {known_sql('longest')} AS longest, {known_sql('events')} AS events")


@query(f"WITH {doy_cte('tasmax', 0.9)}, {with_doy()}, " + RUNS.format(k=KS, flag="tasmax >= threshold", src="x")[5:] + f"""
, e AS (SELECT {KS}, island, count(*) AS n, min(pos) AS start_pos, avg(tasmax - threshold) AS m, max(tasmax) AS peak FROM i WHERE on_ = 1 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY m DESC, start_pos) AS rn FROM e WHERE n >= 2)
SELECT {KS}, round(peak - 273.15, 6) AS amplitude, round(m, 6) AS magnitude FROM (SELECT DISTINCT {KS} FROM x) LEFT JOIN (SELECT * FROM o WHERE rn = 1) USING ({KS})""", last=1998)
def heatwave_amplitude_magnitude(spark, d):
    return indices.heatwave_peaks(p(spark, d), M, "tasmax", 0.9, BASE, 2)


@query(f"WITH t AS (SELECT {MS}, d0 AS doy, greatest(avg(tasmax) + 5, 300.15) AS threshold FROM (SELECT *, {DOY} AS d0 FROM panel WHERE scenario = 'historical' AND year BETWEEN 1995 AND 1998 AND {LEAP}) GROUP BY ALL), {with_doy()}, " + RUNS.format(k=KS, flag="tasmax >= threshold", src="x")[5:] + f"""
, n AS (SELECT {KS}, max(length) AS longest, CAST(sum(length) AS BIGINT) AS total, count(*) AS events FROM r GROUP BY ALL), a AS (SELECT {KS}, count(*) AS n_days FROM x GROUP BY ALL)
SELECT {KS}, n_days, coalesce(longest, 0) AS longest, coalesce(total, 0) AS days_in_runs, coalesce(events, 0) AS events FROM a LEFT JOIN n USING ({KS})""", last=1998)
def heatwave_duration_events_delta(spark, d):
    return indices.heatwave_delta(p(spark, d), M, "tasmax", BASE, 5.0, 300.15, 1)


@query(f"SELECT {KS}, round(avg(tasmax - tasmin), 6) AS daily_range, round(max(tasmax) - min(tasmin), 6) AS extreme_range FROM panel GROUP BY ALL", last=1998)
def daily_and_extreme_temp_range(spark, d):
    return indices.temperature_ranges(p(spark, d), K)


RH = f"h AS (SELECT *, tas - 273.15 AS c, least(greatest(CASE WHEN max(hurs) OVER (PARTITION BY {KS}) <= 1.5 THEN hurs * 100 ELSE hurs END, 0), 100) AS rh FROM panel WHERE {LEAP})"
WB = f"{RH}, w AS (SELECT *, c * atan(0.151977 * sqrt(rh + 8.313659)) + atan(c + rh) - atan(rh - 1.676331) + 0.00391838 * pow(rh, 1.5) * atan(0.023101 * rh) - 4.686035 AS wb FROM h)"


@query(f"WITH {RH} SELECT {KS}, date, round(rh, 6) AS hurs FROM h", last=1998)
def rh_rescale(spark, d):
    from isohyet.functions.units import not_feb29

    return indices.rescale_humidity(p(spark, d).where(not_feb29(F.col("date"))), K).select(*K, "date", "hurs")


@query(f"WITH {WB} SELECT {KS}, date, round(wb, 6) AS wb FROM w", last=1998)
def wet_bulb_stull(spark, d):
    return indices.wet_bulb_days(p(spark, d), K).select(*K, "date", "wb")


@query(f"WITH {WB} SELECT {KS}, round(avg(wb), 6) AS wb_mean, round(max(wb), 6) AS wb_max, CAST(count(*) FILTER (wb >= 25) AS DOUBLE) AS wb_days_ge, CAST(count(*) FILTER (c - wb <= 14) AS DOUBLE) AS depression_days_le FROM w GROUP BY ALL", last=1998)
def wet_bulb_indices(spark, d):
    return indices.wet_bulb_indices(p(spark, d), K, 25.0, 14.0)


@query(f"WITH g AS (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY date) - 1 AS place FROM panel WHERE {LEAP}), "
       + RUNS.format(k=KS, flag="tas > 293.15", src="g")[5:].replace("min(pos)", "min(place)")
       + f", s AS (SELECT {KS}, min(start_pos) AS st FROM r WHERE length >= 3 GROUP BY ALL), l AS (SELECT * FROM g WHERE month(date) >= 7), "
       + RUNS.format(k=KS, flag="tas < 293.15", src="l")[5:].replace("f AS", "f2 AS").replace("i AS", "i2 AS").replace("FROM f)", "FROM f2)").replace("r AS", "r2 AS").replace("FROM i ", "FROM i2 ").replace("min(pos)", "min(place)")
       + f", n AS (SELECT {KS}, min(start_pos) AS en FROM r2 WHERE length >= 3 GROUP BY ALL), a AS (SELECT {KS}, count(*) AS n FROM g GROUP BY ALL) "
       + f"SELECT {KS}, CAST(CASE WHEN st IS NULL THEN 0 WHEN en IS NULL THEN n - st ELSE greatest(en - st, 0) END AS DOUBLE) AS gsl FROM a LEFT JOIN s USING ({KS}) LEFT JOIN n USING ({KS})", last=1998)
def growing_season_length(spark, d):
    return indices.growing_season_length(p(spark, d), K, "tas", 293.15, 3)


@query(f"SELECT {KS}, CAST(count(*) FILTER (pr > 2.5) AS DOUBLE) AS rainy_2_5, CAST(count(*) FILTER (pr > 5.0) AS DOUBLE) AS rainy_5_0, round(max(pr), 6) AS rx1day, round(coalesce(sum(pr) / nullif(count(*) FILTER (pr >= 1), 0), 0), 6) AS sdii, round(coalesce(sum(pr) FILTER (pr >= 1), 0), 6) AS prcptot FROM panel GROUP BY ALL", last=1998)
def rainy_days_rx1day_sdii_prcptot(spark, d):
    return indices.rain_indices(p(spark, d), K, rainy=(2.5, 5.0))


@query(f"WITH q AS (SELECT *, CASE WHEN count(pr) OVER w = 5 THEN sum(pr) OVER w END AS s5 FROM panel WINDOW w AS (PARTITION BY {KS} ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), y AS (SELECT * FROM q WHERE s5 IS NOT NULL), "
       + RUNS.format(k=KS, flag="s5 >= 20", src="y")[5:] + f", n AS (SELECT {KS}, count(*) AS ev FROM r GROUP BY ALL) SELECT {KS}, round(max(s5), 6) AS rx5day, CAST(coalesce(any_value(ev), 0) AS DOUBLE) AS rx5day_events FROM y LEFT JOIN n USING ({KS}) GROUP BY ALL", last=1998)
def rx5day_and_events(spark, d):
    return indices.rx5day(p(spark, d), K, "pr", 20.0)


@query(RUNS.format(k=KS, flag="pr >= 2", src="panel") + ", " + RUNS.format(k=KS, flag="pr < 2", src="panel")[5:].replace("f AS", "f2 AS").replace("i AS", "i2 AS").replace("FROM f)", "FROM f2)").replace("r AS", "r2 AS").replace("FROM i ", "FROM i2 ")
       + f", a AS (SELECT DISTINCT {KS} FROM panel), w AS (SELECT {KS}, max(length) AS cwd FROM r GROUP BY ALL), dr AS (SELECT {KS}, max(length) AS cdd, count(*) FILTER (length >= 3) AS ev FROM r2 GROUP BY ALL) "
       + f"SELECT {KS}, CAST(coalesce(cwd, 0) AS DOUBLE) AS cwd, CAST(coalesce(cdd, 0) AS DOUBLE) AS cdd, CAST(coalesce(ev, 0) AS DOUBLE) AS dry_events FROM a LEFT JOIN w USING ({KS}) LEFT JOIN dr USING ({KS})", last=1998)
def consecutive_wet_dry_days(spark, d):
    return indices.wet_and_dry_runs(p(spark, d), K, "pr", 2.0, 3)


@query(f"WITH t AS (SELECT {MS}, {NEAREST.format(v='pr', q=0.95)} AS c FROM panel WHERE scenario = 'historical' AND year BETWEEN 1995 AND 1998 AND {LEAP} AND pr >= 1 GROUP BY ALL), "
       f"z AS (SELECT {KS}, any_value(c) AS c, coalesce(sum(pr) FILTER (pr >= 1 AND pr >= c), 0) AS hv, coalesce(sum(pr) FILTER (pr >= 1), 0) AS tt FROM panel LEFT JOIN t USING ({MS}) WHERE {LEAP} GROUP BY {KS}) "
       f"SELECT {KS}, CASE WHEN c IS NOT NULL THEN round(hv, 6) END AS r95p_total, CASE WHEN c IS NOT NULL THEN CASE WHEN tt > 0 THEN round(hv / tt * 100, 6) ELSE 0 END END AS r95p_contribution FROM z", last=1998)
def r95p_total_and_contribution(spark, d):
    return indices.r95p(p(spark, d), M, BASE)


@query(f"WITH b AS (SELECT {MS}, avg(pr) AS m, stddev_pop(pr) AS s FROM panel WHERE scenario = 'historical' AND year BETWEEN 1995 AND 1998 GROUP BY ALL), t AS (SELECT {KS}, sum(pr) AS t FROM panel GROUP BY ALL) SELECT {KS}, CASE WHEN s = 0 THEN 0 ELSE round((t - 365 * m) / (sqrt(365.0) * s), 6) END AS spi FROM t JOIN b USING ({MS})", last=1998)
def spi_simplified(spark, d):
    return indices.spi_simplified(p(spark, d), M, BASE)


@query(f"SELECT {KS}, date, round(tas, 6) AS tas FROM panel WHERE year BETWEEN 1996 AND 1997 OR (SELECT count(*) FROM panel q WHERE q.state = panel.state AND q.district = panel.district AND q.model = panel.model AND q.scenario = panel.scenario AND q.year BETWEEN 1996 AND 1997) = 0", last=1998)
def filter_baseline(spark, d):
    return thresholds.filter_baseline(p(spark, d), SERIES, 1996, 1997, strict=False).select(*K, "date", "tas")


@query(f"SELECT {KS}, date, CAST({DOY} AS INT) AS doy FROM panel WHERE {LEAP}", last=1998)
def drop_feb29_doy_noleap(spark, d):
    from isohyet.functions.units import doy_noleap, not_feb29

    return p(spark, d).where(not_feb29(F.col("date"))).select(*K, "date", doy_noleap(F.col("date")).alias("doy"))
