"""Stale partitions: what changed is written, nothing else, and the result equals a full build."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from isohyet.plans import registry, upkeep
from isohyet.sources import stale

SLUGS = ["txx_annual_max", "tx90p_hot_days_pct", "prcptot_annual_total", "dtr_daily_temp_range", "tasmin_winter_mean", "pr_max_5day_precip"]
UNIT = ["unit", "model"]
BASE = (1997, 1999)


def days_of(spark):
    rows = [(u, m, "historical" if y < 2000 else "ssp245", dt.date(y, 1, 1) + dt.timedelta(i), y, 290.0 + (i * 7 + y + len(m)) % 30, 280.0 + i % 9, 285.0, 0.5, float((i + y) % 6)) for u in ("u", "v") for m in ("A", "NN") for y in range(1997, 2003) for i in range(0, 365, 5)]
    return spark.createDataFrame(rows, "unit string, model string, scenario string, date date, year int, tasmax double, tasmin double, tas double, hurs double, pr double")


def table(rows):
    return sorted(tuple(r) for r in rows.select("slug", *UNIT, "scenario", "year", F.round("value", 9)).collect())


def refreshed(spark, days, root):
    return sorted(tuple(r) for r in upkeep.refresh_yearly(days, UNIT, root, SLUGS, BASE).collect())


def test_refresh(spark, tmp_path):
    days, root = days_of(spark).cache(), str(tmp_path / "t")
    schema = registry.build(days, UNIT, SLUGS, BASE).schema
    read = lambda: table(upkeep.read_yearly(spark, root, schema))
    assert read() == []
    first = refreshed(spark, days, root)
    assert len(first) == len(SLUGS) * 2 * 6 and {r[4] for r in first} == {"new"}
    assert read() == table(registry.build(days, UNIT, SLUGS, BASE))
    # nothing changed, or only the order of rows: nothing is written
    assert refreshed(spark, days.orderBy(F.desc("date")), root) == [] and stale.versions(spark, root) == [1]

    # one variable of one year of one model, outside the baseline
    wetter = days.withColumn("pr", F.when((F.col("model") == "A") & (F.col("year") == 2001), F.col("pr") + 1).otherwise(F.col("pr")))
    assert refreshed(spark, wetter, root) == [(s, "A", "ssp245", 2001, "changed") for s in sorted(["prcptot_annual_total", "pr_max_5day_precip"])]
    folders = {os.path.relpath(os.path.dirname(f), f"{root}/data/version=2") for f in glob.glob(f"{root}/data/version=2/**/*.parquet", recursive=True)}
    assert folders == {f"slug={s}/model=A/scenario=ssp245/year=2001" for s in ("prcptot_annual_total", "pr_max_5day_precip")}
    assert read() == table(registry.build(wetter, UNIT, SLUGS, BASE))

    # a year of the baseline: indices against it change in all years of that model; winters read the December before
    warmer = wetter.withColumn("tasmax", F.when((F.col("model") == "NN") & (F.col("year") == 1998), F.col("tasmax") + 2).otherwise(F.col("tasmax")))
    changed = refreshed(spark, warmer, root)
    assert {r[3] for r in changed if r[0] == "tx90p_hot_days_pct"} == set(range(1997, 2003)) and {r[3] for r in changed if r[0] == "txx_annual_max"} == {1998} and {r[1] for r in changed} == {"NN"}
    colder = warmer.withColumn("tasmin", F.when((F.col("model") == "A") & (F.col("year") == 2000), F.col("tasmin") - 1).otherwise(F.col("tasmin")))
    assert {r[3] for r in refreshed(spark, colder, root) if r[0] == "tasmin_winter_mean"} == {2000, 2001}
    assert read() == table(registry.build(colder, UNIT, SLUGS, BASE))

    # a year that is gone isn't read any more; old versions can go
    short = colder.where("year < 2002")
    gone = refreshed(spark, short, root)
    assert {(r[3], r[4]) for r in gone} == {(2002, "gone")} and read() == table(registry.build(short, UNIT, SLUGS, BASE))
    assert stale.remove_old(spark, root) > 0 and read() == table(registry.build(short, UNIT, SLUGS, BASE))


def test_a_run_that_dies_changes_nothing(spark, tmp_path):
    root, keys = str(tmp_path / "t"), ["k"]
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    now = lambda r: stale.digests(r, keys, [], ["v"]).select("k", "digest")
    read = lambda: sorted(tuple(r) for r in stale.read(spark, root, rows.schema, keys).collect())
    stale.refresh(now(rows), lambda s: rows.join(s, keys, "left_semi"), root, keys)
    after = rows.withColumn("v", F.when(F.col("k") == "b", F.col("v") * 10).otherwise(F.col("v")))

    def dies(s):
        after.join(s, keys, "left_semi").withColumn("version", F.lit(2)).write.partitionBy("k").parquet(f"{root}/data/version=2")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stale.refresh(now(after), dies, root, keys)
    assert read() == [("a", 1), ("b", 2), ("b", 3)]
    # a key whose new rows are none, and repeated rows
    assert [tuple(r) for r in stale.refresh(now(after), lambda s: after.join(s, keys, "left_semi").where("v > 20"), root, keys).collect()] == [("b", "changed")]
    assert read() == [("a", 1), ("b", 30)]
    twice = after.unionAll(after.where("k = 'a'"))
    assert [tuple(r) for r in stale.refresh(now(twice), lambda s: twice.join(s, keys, "left_semi"), root, keys).collect()] == [("a", "changed")]
    none = stale.refresh(now(after.where("v = 5")), lambda s: after, root, keys)
    assert {r.change for r in none.collect()} == {"gone"} and read() == []
