"""Special functions against the standard library and against integration."""

import math
import statistics

import numpy as np
from pyspark.sql import functions as F

from isohyet.functions import special


def integral(shape: float, x: float) -> float:
    """P(shape, x) by Simpson's rule on t = u^m, which takes the singularity away; both tails are summed from their own end."""
    m = max(1.0, 2 / shape)

    def part(lo: float, hi: float) -> float:
        u = np.linspace(lo ** (1 / m), hi ** (1 / m), 40_001)
        t = u**m
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.exp(np.where(t > 0, (shape - 1) * np.log(t) - t - math.lgamma(shape), -np.inf)) * m * u ** (m - 1)
        f = np.nan_to_num(f)
        w = np.ones(len(u))
        w[1:-1:2], w[2:-1:2] = 4, 2
        return float((w * f).sum() * (u[1] - u[0]) / 3)

    low = max(0.0, shape - 14 * math.sqrt(shape) - 1) if shape > 50 else 0.0
    return part(low, x) if x > low else 0.0


def test_gamma_against_integration(spark):
    cases = [(a, a * f) for a in (0.3, 0.5, 1.0, 2.5, 7.9, 8.1, 30.0, 400.0) for f in (0.05, 0.4, 0.9, 1.0, 1.1, 1.6, 3.0)] + [(2.0, 1e-6), (4000.0, 4100.0), (40_000.0, 39_900.0)]
    got = spark.createDataFrame(cases, "a double, x double").select("a", "x", special.gamma_cdf(F.col("x"), F.col("a")).alias("p")).collect()
    for r in got:
        want = integral(r.a, r.x)
        assert abs(r.p - want) <= 1e-9 * max(want, 1e-12), (r, want)
    # the upper tail keeps its own digits
    upper = spark.createDataFrame([(3.0, 40.0)], "a double, x double").select(special._fraction(F.col("a"), F.col("x")).alias("q")).first().q
    assert abs(upper / (math.exp(-40) * (1 + 40 + 800)) - 1) < 1e-12


def test_gamma_closed_forms_and_edges(spark):
    rows = [(1.0, 1.0, 1 - math.exp(-1)), (2.0, 2.0, 1 - 3 * math.exp(-2)), (0.5, 0.5, math.erf(math.sqrt(0.5))), (3.0, 10.0, 1 - 61 * math.exp(-10)), (2.0, 0.0, 0.0), (2.0, -3.0, 0.0), (2.0, 1e9, 1.0)]
    rows += [(0.0, 1.0, None), (-1.0, 1.0, None), (None, 1.0, None), (1.0, None, None), (1.0, float("nan"), None)]
    got = spark.createDataFrame(rows, "a double, x double, want double").select("want", special.gamma_cdf(F.col("x"), F.col("a")).alias("p")).collect()
    assert all((r.p is None) == (r.want is None) and (r.p is None or abs(r.p - r.want) < 1e-13) for r in got)


def test_gamma_of_very_large_shapes(spark):
    """The two ways agree where one takes over from the other."""
    a = 9e5
    xs = [a + d * math.sqrt(a) for d in (-4.0, -1.5, -0.2, 0.0, 1e-3, 0.7, 3.0)]
    cols = [special.gamma_cdf(F.col("x"), F.lit(a)).alias("fold"), special._far(F.lit(a), F.col("x")).alias("far")]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select(*cols).collect():
        assert abs(r.fold - r.far) < 1e-8, r
    got = spark.createDataFrame([(1e12, 1e12 + 1e6)], "a double, x double").select(special.gamma_cdf(F.col("x"), F.col("a")).alias("p")).first().p
    assert abs(got - statistics.NormalDist().cdf(1.0)) < 1e-6


def test_log_gamma(spark):
    xs = [1e-8, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 171.0, 1e6, 1e12]
    for r in spark.createDataFrame([(x,) for x in [*xs, -1.0, 0.0, None]], "x double").select("x", special.log_gamma(F.col("x")).alias("g")).collect():
        assert r.g is None if r.x is None or r.x <= 0 else abs(r.g - math.lgamma(r.x)) <= 1e-13 * max(1, abs(math.lgamma(r.x)))


def test_normal_law_and_quantile(spark):
    law = statistics.NormalDist()
    zs = [-30.0, -8.0, -4.8, -2.0, -1.8, -1.0, -1e-9, 0.0, 0.3, 1.79, 1.81, 3.0, 7.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", special.normal_cdf(F.col("z")).alias("p")).collect():
        want = math.erfc(-r.z / math.sqrt(2)) / 2
        assert abs(r.p - want) <= 1e-12 * want, r
    ps = [1e-300, 1e-12, 1e-6, 0.01, 0.075, 0.4, 0.5, 0.6, 0.925, 0.9999, 1 - 1e-12]
    for r in spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -0.1, None]], "p double").select("p", special.normal_quantile(F.col("p")).alias("z")).collect():
        assert r.z is None if r.p not in ps else abs(r.z - law.inv_cdf(r.p)) <= 1e-13 * max(1, abs(r.z))


def test_sql_twins(spark):
    import duckdb

    rows = [(a, x) for a in (0.4, 1.0, 3.3, 25.0) for x in (0.01, 0.7, 3.0, 20.0, 90.0)]
    got = [r.p for r in spark.createDataFrame(rows, "a double, x double").select(special.gamma_cdf(F.col("x"), F.col("a")).alias("p")).collect()]
    values = ", ".join(f"({i}, {a}::DOUBLE, {x}::DOUBLE)" for i, (a, x) in enumerate(rows))
    want = [p for _, p in duckdb.sql(f"SELECT i, {special.gamma_cdf_sql('x', 'a')} AS p FROM (VALUES {values}) t(i, a, x) ORDER BY i").fetchall()]
    assert np.allclose(got, want, rtol=1e-11)
    ps = (1e-6, 0.03, 0.3, 0.5, 0.8, 0.99, 1 - 1e-6)
    got = [r.z for r in spark.createDataFrame([(p,) for p in ps], "p double").select(special.normal_quantile(F.col("p")).alias("z")).collect()]
    want = [z for _, z in duckdb.sql(f"SELECT i, {special.normal_quantile_sql('p')} AS z FROM (VALUES {', '.join(f'({i}, {p!r}::DOUBLE)' for i, p in enumerate(ps))}) t(i, p) ORDER BY i").fetchall()]
    assert np.allclose(got, want, rtol=1e-13, atol=1e-15)
