"""Known answers on synthetic daily series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from isohyet.operators import indices, runs, thresholds

K = ["unit", "model", "scenario", "year"]
U = ["unit", "model"]


def series(spark, values, start=dt.date(2001, 1, 1), var="tasmax", scenario="historical", unit="u"):
    rows = [(unit, "m", scenario, start + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"unit string, model string, scenario string, date date, {var} double").withColumn("year", F.year("date"))


def one(df, column):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][column]


def test_bimodal_percentiles(spark):
    hot = series(spark, [273.15] * 90 + [373.15] * 10)
    assert one(indices.percentile_days(hot, K, "tasmax", 0.9), "pct_days") == 10
    cold = series(spark, [223.15] * 10 + [293.15] * 90)
    assert one(indices.percentile_days(cold, K, "tasmax", 0.1, above=False), "pct_days") == 10


@pytest.mark.parametrize(("values", "flag", "days", "longest"), [([20] * 350 + [50] * 15, "v > 20", 15, 15), ([-10] * 15 + [25] * 350, "v < 25", 15, 15)])
def test_spell_days(spark, values, flag, days, longest):
    stats = runs.run_stats(series(spark, values, var="v"), K, F.expr(flag), 6).first()
    assert (stats.days_in_runs, stats.longest, stats.events) == (days, longest, 1)


def test_runs_go_over_positions(spark):
    days = series(spark, [5, 5, None, 5, 0, 5], var="v").where("v is not null")
    assert runs.run_stats(days, K, F.col("v") > 1, 1).first().longest == 3
    assert runs.run_stats(days, K, F.col("v") > 9, 1).first().events == 0


def test_wet_and_dry_runs(spark):
    rain = series(spark, [5] * 10 + [0] * 5 + [5] * 20 + [0] * 330, var="pr")
    assert one(indices.wet_and_dry_runs(rain, K), "cwd") == 20
    assert one(indices.wet_and_dry_runs(series(spark, [5] * 5 + [0] * 30 + [5] * 5 + [0] * 325, var="pr"), K), "cdd") == 325


def test_rain(spark):
    mixed = indices.rain_indices(series(spark, [20] * 100 + [10] * 100 + [0] * 165, var="pr"), K).first()
    assert mixed.sdii == 15
    wet = indices.rain_indices(series(spark, [10] * 100 + [0] * 265, var="pr"), K).first()
    assert wet.prcptot == 1000 and wet.rx1day == 10
    flat = indices.rain_indices(series(spark, [10] * 365, var="pr"), K).first()
    assert flat.rainy_2_5 == 365
    assert one(indices.rx5day(series(spark, [10] * 365, var="pr"), K), "rx5day") == 50
    dry = indices.rain_indices(series(spark, [0] * 20, var="pr"), K).first()
    assert dry.sdii == 0 and dry.prcptot == 0


def test_r95p(spark):
    rain = series(spark, [1] * 95 + [100] * 5, var="pr")
    got = indices.r95p(rain, U, (2001, 2001)).first()
    assert got.r95p_total == 595 and got.r95p_contribution == 100  # rank rint(94.05) still holds 1 mm, and days at the cut count
    assert indices.r95p(rain, U, (1981, 1990)).first().r95p_total is None


def test_djf_crosses_years(spark):
    values = [283.15 if (dt.date(2001, 1, 1) + dt.timedelta(i)).month in (12, 1, 2) else 303.15 for i in range(730)]
    got = {r.year: r.seasonal_mean for r in indices.seasonal_mean(series(spark, values, var="tas"), K, "tas", (12, 1, 2)).collect()}
    assert got[2001] is None and abs(got[2002] - 10) < 1e-9


@pytest.mark.parametrize(("t", "rh", "wb"), [(20, 50, 13.7), (30, 80, 27.4), (35, 75, 31.1)])
def test_stull(spark, t, rh, wb):
    days = series(spark, [t + 273.15], var="tas").withColumn("hurs", F.lit(float(rh)))
    assert abs(one(indices.wet_bulb_days(days, K), "wb") - wb) < 0.5
    fraction = series(spark, [t + 273.15], var="tas").withColumn("hurs", F.lit(rh / 100))
    assert abs(one(indices.wet_bulb_days(fraction, K), "wb") - wb) < 0.5


def test_nearest_quantile_rounds_half_to_even(spark):
    v = spark.createDataFrame([(float(i),) for i in range(1, 7)], "v double")
    assert v.agg(thresholds.nearest_quantile("v", 0.5).alias("q")).first().q == 3.0  # rank 2.5 to 2
    assert v.agg(thresholds.nearest_quantile("v", 0.9).alias("q")).first().q == 5.0  # rank 4.5 to 4


def test_thresholds_wrap_around_the_year(spark):
    t = thresholds.doy_thresholds(series(spark, range(365), var="v"), U, "v", 1.0)
    got = {r.doy: r.threshold for r in t.collect()}
    assert got[1] == 364 and got[365] == 364 and got[100] == 101 and len(got) == 365


def test_missing_threshold_counts_as_a_day(spark):
    base = series(spark, [300] * 20)
    late = series(spark, [310] * 40, start=dt.date(2005, 1, 1), scenario="ssp245")
    got = {r.scenario: r.pct_days for r in indices.doy_exceedance(base.unionByName(late), U, "tasmax", 0.9, (2001, 2001), window=1).collect()}
    assert got["ssp245"] == 50 and got["historical"] == 100
    spells = {r.scenario: r.days_in_runs for r in indices.spell_days(base.unionByName(late), U, "tasmax", 0.9, (1981, 1990)).collect()}
    assert spells == {"ssp245": None, "historical": None}


def test_growing_season(spark):
    warm = [273.15 + (10 if 60 <= i < 280 else 0) for i in range(365)]
    assert one(indices.growing_season_length(series(spark, warm, var="tas"), K), "gsl") == 220
    assert one(indices.growing_season_length(series(spark, [270] * 365, var="tas"), K), "gsl") == 0
    assert one(indices.growing_season_length(series(spark, [290] * 365, var="tas"), K), "gsl") == 365


def test_hottest_spell_takes_the_first_of_equals(spark):
    days = series(spark, [1] * 3 + [9] * 5 + [1] * 3 + [9] * 5 + [12], var="v").withColumn("t", F.lit(5.0))
    got = runs.hottest_spell(days, K, "v", "t", 5).first()
    assert got.peak == 12 and abs(got.magnitude - 4.5) < 1e-9


def test_folds_equal_islands(spark):
    """Runs and peaks folded over a year's days in order, against windows over the same days."""
    rng = random.Random(4)
    rows = [(u, dt.date(2001, 1, 1) + dt.timedelta(i), rng.choice([None, 1.0, 2.0, 3.0, 3.5])) for u in range(8) for i in range(90) if rng.random() < 0.9]
    days = spark.createDataFrame(rows, "u int, date date, v double").withColumn("t", F.lit(2.0)).cache()
    year = days.groupBy("u").agg(runs.in_order("date", "v", "t").alias("d"))
    for least in (1, 2, 4, 40):
        got = year.select("u", runs.folded_runs(F.col("d"), lambda x: x["v"] >= 2.0, least).alias("r")).select("u", "r.*").collect()
        want = runs.run_stats(days, ["u"], F.col("v") >= 2.0, least).select("u", "longest", "days_in_runs", "events").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        peaks = {r.u: (r.p.magnitude, r.p.peak) for r in year.select("u", runs.folded_peak(F.col("d"), lambda x: x["v"], lambda x: x["t"], least).alias("p")).collect()}
        hot = {r.u: (r.magnitude, r.peak) for r in runs.hottest_spell(days, ["u"], "v", "t", least).collect()}
        for u, (m, p) in peaks.items():
            assert (m, p) == (None, None) if u not in hot else (abs(m - hot[u][0]) < 1e-12 and p == hot[u][1])


def test_thresholds_of_all_values_and_quantiles(spark):
    """One structure for two values and three quantiles, over a year with holes, against a plain reading."""
    rng = random.Random(5)
    rows = [(m, dt.date(y, 1, 1) + dt.timedelta(i), float(rng.randint(0, 40)), rng.choice([None, 1.5, 2.5])) for m in "ab" for y in (2000, 2001) for i in range(366) if not 100 <= i < 110 and rng.random() < 0.7]
    base = spark.createDataFrame(rows, "m string, date date, x double, y double")
    wanted = {"x9": ("x", 0.9), "x1": ("x", 0.1), "y5": ("y", 0.5)}
    got = {r.m: r for r in thresholds.doy_arrays(base, ["m"], wanted).collect()}
    for m in "ab":
        held = {}
        for mm, date, x, y in rows:
            if mm == m and not (date.month == 2 and date.day == 29):
                doy = date.timetuple().tm_yday - (date.year == 2000 and date.month > 2)
                held.setdefault(doy, []).append((x, y))
        for name, (v, q) in wanted.items():
            for doy in range(1, 366):
                near = sorted(p["xy".index(v)] for o in range(-2, 3) for p in held.get((doy - 1 + o) % 365 + 1, []) if p["xy".index(v)] is not None)
                assert got[m][name][doy - 1] == (near[round((len(near) - 1) * q)] if near else None)
