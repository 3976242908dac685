"""Ranks and quantiles without a task that holds a group, and the pyramid of nearest centres, against plain readings."""

import numpy as np
from pyspark.sql import functions as F

from isohyet.operators import order_stats, ranking, spatial


def test_rank_over_ranges(spark):
    """Ties across what could be boundaries, a value that a third of all rows share, nulls; both directions."""
    rng = np.random.default_rng(1)
    values = [float(v) for v in np.concatenate([rng.integers(0, 50, 400), np.full(300, 17), rng.random(200) * 50])] + [None, None]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, v double").repartition(7)
    known = [v for v in values if v is not None]
    for down in (True, False):
        got = {r.id: (r["rank"], r.total) for r in order_stats.with_rank(rows, F.col("v"), down).collect()}
        assert got == {i: (None, None) if v is None else (1 + sum(w > v if down else w < v for w in known), len(known)) for i, v in enumerate(values)}
    assert order_stats.with_rank(rows.where("1 = 0"), F.col("v")).count() == 0


def test_ranks_need_no_single_partition(spark):
    rows = spark.createDataFrame([(1, 2.0)], "id int, v double")
    plan = order_stats.with_rank(rows, F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_quantiles_equal_percentile(spark):
    """A million values in one group, half of them equal, beside small groups, one value, infinities and nulls."""
    shares = {"lo": 0.02, "mid": 0.5, "hi": 0.98, "p3": 1 / 3}
    big = spark.range(1_000_000).select(F.lit("big").alias("k"), F.when(F.col("id") % 2 == 0, 3.25).otherwise(F.pow(F.rand(3) - 0.4, F.lit(3.0)) * 1e4).alias("v"))
    narrow = spark.range(250_000).select(F.lit("narrow").alias("k"), (1e6 + F.rand(5) * 1e-3).alias("v"))
    rest = [("one", 5.0), *[("few", float(x)) for x in (3, -1, 4, 1, -5, 9, 2, 6)], ("zero", 0.0), ("zero", -0.0), ("zero", 0.0), ("mixed", -1e300), ("mixed", 1e-300), ("mixed", 7.0), ("none", None), ("nan", float("nan")), ("nan", 2.0)]
    rows = big.union(narrow).union(spark.createDataFrame(rest, "k string, v double")).cache()
    want = {r.k: r for r in rows.where("v is not null and not isnan(v)").groupBy("k").agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(q)).alias(c) for c, q in shares.items()]).collect()}
    for most in (100_000, 3000):
        got = {r.k: r for r in order_stats.exact_quantiles(rows, ["k"], "v", shares, most=most).collect()}
        assert got.keys() == want.keys()
        assert all((got[k].n, *[got[k][c] for c in shares]) == (want[k].n, *[want[k][c] for c in shares]) for k in want), most
    whole = order_stats.exact_quantiles(rows.where("k = 'few'"), [], "v", {"mid": 0.5}).first()
    assert (whole.mid, whole.n, whole.lowest, whole.highest) == (2.5, 8, -5.0, 9.0)
    assert order_stats.exact_quantiles(rows.where("1 = 0"), ["k"], "v", shares).count() == 0


def test_scale_never_falls(spark):
    rng = np.random.default_rng(2)
    v = np.sort(np.concatenate([rng.standard_normal(2000) * 10.0 ** rng.integers(-300, 300, 2000), 2.0 ** np.arange(-40, 40), -(2.0 ** np.arange(-40, 40)), [0.0, 5e-324, -5e-324, np.inf, -np.inf, 1.7e308]]))
    got = [r.c for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double").select("i", order_stats._scale(F.col("v")).alias("c")).orderBy("i").collect()]
    assert all(a <= b for a, b in zip(got, got[1:]))


def test_robust_range_of_one_value(spark):
    rows = spark.createDataFrame([("a", 2.0)] * 3 + [("b", float(i)) for i in range(101)] + [("b", float("inf"))], "k string, value double")
    got = {r.k: (r.vmin, r.vmax, r.lowest, r.highest) for r in ranking.robust_range(rows, ["k"]).collect()}
    assert got == {"a": (1.0, 3.0, 2.0, 2.0), "b": (2.0, 98.0, 0.0, 100.0)}


def test_pyramid_equals_all_pairs(spark):
    """Dense clusters, far points, negative coordinates, points on centres and on cell borders, ties by name."""
    rng = np.random.default_rng(3)
    centres = [(f"c{i:03}", float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.random((60, 2)) * 0.5 - 7, rng.integers(-5, 5, (30, 2)), 1000 + rng.random((4, 2))]))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.random((80, 2)) * 20 - 10, rng.integers(-6, 6, (60, 2)), [[1e5, -1e5], [500.0, 500.0], [-7.0, -7.0]]]))]
    c, p = spark.createDataFrame(centres, "unit_key string, cx double, cy double"), spark.createDataFrame(points, "id int, x double, y double")
    for size in (1.0, 0.1):
        got = {r.id: r.unit_key for r in spatial.nearest(p, c, "id", size=size).collect()}
        assert got == {i: min(centres, key=lambda u: ((u[1] - x) ** 2 + (u[2] - y) ** 2, u[0]))[0] for i, x, y in points}
    assert spatial.nearest(p.where("1 = 0"), c, "id").count() == 0
