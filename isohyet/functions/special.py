"""Special functions as column expressions: log-gamma, the incomplete gamma function, the normal law and its quantile.

The iterations are folds over as many steps as a row needs, so nothing leaves the
JVM. The SQL twins at the end are written another way where SQL has a builtin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_ROOT_2PI = 0.5 * math.log(2 * math.pi)
#: Stirling's series: coefficients of 1/x, 1/x^3, 1/x^5, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
FAR = 1e6  # shapes beyond it are taken by the normal deviate, whose error falls with shape^-1.5
TINY = 1e-300

# The rational approximations of the normal quantile in AS 241 (Wichura 1988), numerators and
# denominators by rising powers: for |p - 1/2| <= 0.425, for r <= 5 and for r > 5, r the root of -ln of the smaller tail.
QUANTILE = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def let(value: Column, use) -> Column:
    """use(value), with the value made once for a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def _stirling(x: Column) -> Column:
    return sum((F.lit(c) / F.pow(x, F.lit(float(2 * i + 1))) for i, c in enumerate(STIRLING)), F.lit(0.0))


def log_gamma(x: Column) -> Column:
    """ln of gamma(x) for x > 0: Stirling's series eight steps up, less the logarithm of the steps; null elsewhere."""

    def above(x):
        steps = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(1.0), lambda p, i: p * (x + i.cast("double")))
        return let(x + 8, lambda y: (y - 0.5) * F.ln(y) - y + LOG_ROOT_2PI + _stirling(y)) - F.ln(steps)

    return let(x.cast("double"), lambda x: F.when(x > 0, above(x)))


def _lead(a: Column, x: Column) -> Column:
    """x^a e^-x / gamma(a + 1), without the difference of large numbers where a is large."""
    near = lambda m: F.exp(-a * (m - F.log1p(m)) - _stirling(a)) / F.sqrt(a * (2 * math.pi))
    return F.when(a < 8, F.exp(a * F.ln(x) - x - log_gamma(a + 1))).otherwise(let((x - a) / a, near))


def _steps(a: Column, more: int) -> Column:
    """Steps after which what is left is below rounding: some times the root of the shape, where an argument is near it."""
    return F.sequence(F.lit(1), (F.lit(more) + F.ceil(F.sqrt(a) * 9)).cast("int"))


def _series(a: Column, x: Column) -> Column:
    """Lower function for x < a + 1: 1 + x / (a + 1) + x^2 / ((a + 1)(a + 2)) + ..."""
    state = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    step = lambda s, i: let(s["t"] * x / (a + i.cast("double")), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s")))
    return _lead(a, x) * F.aggregate(_steps(a, 60), state, step, lambda s: s["s"])


def _fraction(a: Column, x: Column) -> Column:
    """Upper function for x >= a + 1: its continued fraction, by Lentz's method."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    first = x + 1 - a
    state = let(1 / safe(first), lambda d: F.struct(F.lit(1 / TINY).alias("c"), d.alias("d"), d.alias("h")))

    def step(s, i):
        i = i.cast("double")
        n, b = i * (a - i), first + 2 * i
        cd = F.struct((1 / safe(n * s["d"] + b)).alias("d"), safe(b + n / s["c"]).alias("c"))
        return let(cd, lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (s["h"] * v["c"] * v["d"]).alias("h")))

    return _lead(a, x) * a * F.aggregate(_steps(a, 150), state, step, lambda s: s["h"])


def _far(a: Column, x: Column) -> Column:
    """Lower function for very large shapes, by the normal deviate r + ln(v / r) / r of the likelihood root r."""

    def deviate(m):
        r = F.signum(m) * F.sqrt(2 * a * (m - F.log1p(m)))
        return F.when(F.abs(m) < 1e-4, m * F.sqrt(a) * (1 - m / 3) + 1 / (3 * F.sqrt(a))).otherwise(let(r, lambda r: r + F.ln(m * F.sqrt(a) / r) / r))

    return normal_cdf(let((x - a) / a, deviate))


def gamma_cdf(x: Column, shape: Column, large: bool = True) -> Column:
    """Regularised lower incomplete gamma function P(shape, x); 0 for x <= 0, null where shape isn't positive or either is null."""

    def value(v):
        x, a = v["x"], v["a"]
        near = F.when(x < a + 1, _series(a, x)).otherwise(1 - _fraction(a, x))
        return F.when(x <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(a > FAR, _far(a, x)).otherwise(near) if large else near)))

    known = F.struct(x.cast("double").alias("x"), shape.cast("double").alias("a"))
    return let(known, lambda v: F.when((v["a"] > 0) & v["x"].isNotNull() & ~F.isnan(v["x"]), value(v)))


def normal_cdf(z: Column) -> Column:
    """The standard normal law: P(1/2, z^2 / 2) on each side of the middle, the far tail without a difference."""

    def value(z):
        half = z * z / 2
        inner = (1 + F.signum(z) * gamma_cdf(half, F.lit(0.5), large=False)) / 2
        tail = let(half, lambda h: _fraction(F.lit(0.5), h)) / 2
        return F.when(F.abs(z) < 1.8, inner).when(z < 0, tail).otherwise(1 - tail)

    return let(z.cast("double"), lambda z: F.when(z.isNotNull() & ~F.isnan(z), value(z)))


def _horner(c: tuple[float, ...], r: Column) -> Column:
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = out * r + k
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1; null elsewhere."""
    ratio = lambda k, r: _horner(QUANTILE[k][0], r) / _horner(QUANTILE[k][1], r)

    def value(p):
        q = p - 0.5
        tail = let(F.sqrt(-F.ln(F.least(p, 1 - p))), lambda r: F.when(r <= 5, ratio(1, r - 1.6)).otherwise(ratio(2, r - 5)))
        return F.when(F.abs(q) <= 0.425, q * ratio(0, 0.180625 - q * q)).otherwise(F.signum(q) * tail)

    return let(p.cast("double"), lambda p: F.when((p > 0) & (p < 1), value(p)))


# --- the same in SQL ---------------------------------------------------------------------------------------------


def _horner_sql(c: tuple[float, ...], r: str) -> str:
    out = repr(c[-1])
    for k in reversed(c[:-1]):
        out = f"({out} * {r} + {k!r})"
    return out


def gamma_cdf_sql(x: str, a: str) -> str:
    """P(a, x) as one sum of positive terms x^(a+k) e^-x / gamma(a + k + 1), k = 0, 1, ..., by the builtin lgamma."""
    return f"CASE WHEN {x} <= 0 THEN 0.0 ELSE least(1.0, list_sum(list_transform(range(0, CAST(greatest({x} - {a}, 0) + 9 * sqrt(greatest({x}, {a})) + 80 AS BIGINT)), lambda step: exp(({a} + step) * ln({x}) - {x} - lgamma({a} + step + 1))))) END"


def normal_quantile_sql(p: str) -> str:
    ratio = lambda k, r: f"{_horner_sql(QUANTILE[k][0], r)} / {_horner_sql(QUANTILE[k][1], r)}"
    root = f"sqrt(-ln(least({p}, 1 - {p})))"
    inner = f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(0, inner)} ELSE sign({p} - 0.5) * CASE WHEN {root} <= 5 THEN {ratio(1, f'({root} - 1.6)')} ELSE {ratio(2, f'({root} - 5)')} END END"
