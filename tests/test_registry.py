"""The metric registry: complete, consistent, and buildable as a whole."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from isohyet.plans import registry, registry_queries  # noqa: F401  it registers its queries
from isohyet.plans.catalog import QUERIES


def test_registry():
    slugs = [m.slug for m in registry.METRICS]
    assert len(slugs) == len(set(slugs)) == 55
    assert all(m.kind in registry.PLAIN or m.kind in registry.BUILDERS or m.kind in registry.DOY for m in registry.METRICS)
    assert {s for b in registry.BUNDLES.values() for s in b} <= set(slugs)
    assert [m.slug for m in registry.METRICS if not m.higher_is_worse] == ["gsl_growing_season", "spi3_drought_index", "spi6_drought_index", "spi12_drought_index"]


def test_build_all(spark):
    rows = [("u", "m", "historical" if y < 2003 else "ssp245", dt.date(y, 1, 1) + dt.timedelta(i), 290.0 + (i % 30), 280.0 + (i % 9), 285.0 + (i % 7), 0.5, float(i % 6)) for y in range(1997, 2005) for i in range(0, 365)]
    days = spark.createDataFrame(rows, "unit string, model string, scenario string, date date, tasmax double, tasmin double, tas double, hurs double, pr double").withColumn("year", F.year("date")).cache()
    got = {r.slug: r.n for r in registry.build(days, ["unit", "model"], baseline=(1997, 2002)).groupBy("slug").agg(F.count("value").alias("n")).collect()}
    assert set(got) == {m.slug for m in registry.METRICS}
    # years without a spell keep their rows
    assert got["hwa_heatwave_amplitude"] == 0 and all(n for slug, n in got.items() if slug != "hwa_heatwave_amplitude")
    one = {(r.slug, r.year): r.value for r in registry.build(days, ["unit", "model"], ["txx_annual_max", "pr_max_5day_precip", "fd_frost_days"]).collect()}
    assert one[("txx_annual_max", 2000)] == 319.0 - 273.15 and one[("pr_max_5day_precip", 2000)] == 15 and one[("fd_frost_days", 2000)] == 0


def test_registered_queries_build_every_metric(spark):
    names = ("registry_yearly_plain", "registry_yearly_with_baseline", "registry_yearly_spi")
    got = {r.slug for n in names for r in QUERIES[n](spark, "/root/testdata/sf0.01").select("slug").distinct().collect()}
    assert got == {m.slug for m in registry.METRICS}


def test_users_add_metrics(spark):
    days = spark.createDataFrame([("u", "m", "historical", dt.date(2000, 1, 1 + i), float(i)) for i in range(9)], "unit string, model string, scenario string, date date, pr double").withColumn("year", F.year("date"))
    registry.register(registry.Metric("pr_spread", "pr", "spread", {"times": 2.0}), lambda v, p: (F.max(v) - F.min(v)) * p["times"])
    registry.register(registry.Metric("pr_last", "pr", "last_value"), plan=lambda d, u, m, b: d.groupBy(*u, "scenario", "year").agg(F.max_by(m.var, "date").alias("value")))
    registry.register(registry.Metric("pr_over_5", "pr", "count_gt", {"limit": 5.0}))
    got = {r.slug: r.value for r in registry.build(days, ["unit", "model"], ["pr_spread", "pr_last", "pr_over_5"]).collect()}
    assert got == {"pr_spread": 16.0, "pr_last": 8.0, "pr_over_5": 3.0}
    for bad in (registry.Metric("pr_spread", "pr", "spread"), registry.Metric("txx_annual_max", "tasmax", "max"), registry.Metric("other", "pr", "no_such_kind")):
        with pytest.raises(ValueError):
            registry.register(bad)
    with pytest.raises(ValueError):
        registry.build(days, ["unit", "model"], ["no_such_metric"])
