"""Standardised precipitation index: accumulate, fit, transform, by year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.special import gamma_cdf, normal_quantile
from isohyet.operators.runs import rolling_sum


def month_spine(monthly: DataFrame, keys: list[str], value: str = "total", fill: float | None = 0.0) -> DataFrame:
    """All months between January of the first and December of the last year of each series; missing months take ``fill``."""
    ends = monthly.groupBy(*keys).agg(F.trunc(F.min("month"), "YEAR").alias("a"), F.add_months(F.trunc(F.max("month"), "YEAR"), 11).alias("b"))
    spine = ends.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    joined = spine.join(monthly, [*keys, "month"], "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(fill)) if fill is not None else F.col(value))


def accumulate(monthly: DataFrame, keys: list[str], scale: int, value: str = "total") -> DataFrame:
    """Trailing sums over ``scale`` months, across years; null until full."""
    return rolling_sum(monthly, keys, value, scale, "month", "acc")


def fit(acc: DataFrame, unit: list[str], baseline: tuple[int, int], least: int = 5, gamma_least: int = 20) -> DataFrame:
    """Parameters by calendar month from the same model's historical baseline: n, q (share of zeros), mean, std and, with enough positive values, the gamma shape and scale of maximum likelihood."""
    base = acc.where((F.col("scenario") == "historical") & F.year("month").between(*baseline) & F.col("acc").isNotNull())
    pos = F.when(F.col("acc") > 0, F.col("acc"))
    p = base.groupBy(*unit, F.month("month").alias("moy")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("acc") == 0).cast("double")).alias("q"), F.count(pos).alias("n_pos"), F.avg("acc").alias("mean"), F.stddev_pop("acc").alias("std"),
        F.avg(pos).alias("pos_mean"), F.avg(F.ln(pos)).alias("ln_mean"),
    ).where(F.col("n") >= least)
    s = F.ln("pos_mean") - F.col("ln_mean")
    start = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * F.nullif(s, F.lit(0.0)))
    shape = F.when((F.col("n_pos") >= gamma_least) & (s > 0), start)
    # steps as a fold: nested columns would repeat the step before in every term
    shape = F.aggregate(F.sequence(F.lit(1), F.lit(3)), shape, lambda k, _: _newton(k, s))
    return p.withColumn("shape", shape).withColumn("scale", F.col("pos_mean") / F.col("shape"))


def _digamma(x):
    y = x + 6
    tail = F.ln(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4))) - 1 / (252 * F.pow(y, F.lit(6)))
    return tail - sum((1 / (x + i) for i in range(6)), F.lit(0.0))


def _trigamma(x):
    y = x + 6
    tail = 1 / y + 1 / (2 * y * y) + 1 / (6 * F.pow(y, F.lit(3))) - 1 / (30 * F.pow(y, F.lit(5))) + 1 / (42 * F.pow(y, F.lit(7)))
    return tail + sum((1 / ((x + i) * (x + i)) for i in range(6)), F.lit(0.0))


def _newton(k, s):
    """One step to the root of ln k - digamma(k) - s."""
    return k - (F.ln(k) - _digamma(k) - s) / (1 / k - _trigamma(k))


LIMIT = 4.753424308822899  # the normal quantile of 1 - 1e-6


def to_normal(h: Column) -> Column:
    """A probability, clipped, as a standard normal value."""
    return F.when(h.isNotNull(), normal_quantile(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), h))))


def transform(acc: DataFrame, parameters: DataFrame, unit: list[str], keys: list[str] | None = None) -> DataFrame:
    """spi of each month: by the gamma branch where it was fitted, else (x - mean) / std clipped alike. No parameters, no value.

    ``unit`` names the parameters; ``keys`` (unit and scenario, if not given) are what stays beside month, acc and spi.
    """
    joined = acc.withColumn("moy", F.month("month")).join(parameters, [*unit, "moy"], "left")
    z = (F.col("acc") - F.col("mean")) / F.nullif("std", F.lit(0.0))
    plain = F.when(F.col("std") == 0, 0.0).when(z.isNotNull(), F.greatest(F.least(z, F.lit(LIMIT)), F.lit(-LIMIT)))
    gamma = to_normal(F.col("q") + (1 - F.col("q")) * gamma_cdf(F.col("acc") / F.col("scale"), F.col("shape")))
    return joined.select(*(keys or [*unit, "scenario"]), "month", "acc", F.when(F.col("shape").isNull(), plain).otherwise(gamma).alias("spi"))


def annualize(monthly: DataFrame, keys: list[str], least: int = 9, below: float = -1.0, above: float = 1.0) -> DataFrame:
    """Mean, and months below and above the limits, of years with enough valid months."""
    return (
        monthly.groupBy(*keys, F.year("month").alias("year"))
        .agg(F.count("spi").alias("valid"), F.avg("spi").alias("spi_mean"), F.count_if(F.coalesce(F.col("spi") < below, F.lit(False))).cast("double").alias("months_below"), F.count_if(F.coalesce(F.col("spi") > above, F.lit(False))).cast("double").alias("months_above"))
        .where(F.col("valid") >= least).drop("valid")
    )


def thom_gamma(acc: DataFrame, unit: list[str], baseline: tuple[int, int]) -> DataFrame:
    """Closed-form gamma parameters by calendar month (Thom 1958), for the adapter's branch; values without a spread have none."""
    s = F.ln("pos_mean") - F.col("ln_mean")
    shape = F.when(s > 1e-12, (1 + F.sqrt(1 + 4 * s / 3)) / (4 * s))
    return fit(acc, unit, baseline, least=2, gamma_least=2).withColumn("shape", shape).withColumn("scale", F.col("pos_mean") / F.col("shape"))


def pearson3(acc: DataFrame, parameters: DataFrame, unit: list[str]) -> DataFrame:
    """spi by a Pearson III law from mean, deviation and skewness of each calendar month; a skewness within 0.001 of 0 counts as 0.001."""
    g = F.when(F.abs("skew") < 1e-3, 1e-3).otherwise(F.col("skew"))
    shape = 4 / (g * g)
    t = (F.col("acc") - F.col("mean")) / F.col("std") * F.signum(g) * F.sqrt(shape) + shape
    law = gamma_cdf(t, shape)
    h = F.when(g > 0, law).otherwise(1 - law)
    joined = acc.withColumn("moy", F.month("month")).join(parameters, [*unit, "moy"], "left")
    return joined.select(*unit, "scenario", "month", "acc", F.when((F.col("std") > 0) & F.col("acc").isNotNull(), to_normal(h)).alias("spi"))


def diagnostics(monthly: DataFrame, keys: list[str], baseline: tuple[int, int]) -> DataFrame:
    """Counts, sample moments, extremes, shares beyond 1 and 2, and the baseline's mean and deviation with flags of their validity."""
    share = lambda c: F.avg(c.cast("int")) * 100
    v, base = F.col("spi"), F.when(F.year("month").between(*baseline), F.col("spi"))
    stats = monthly.where("spi is not null").groupBy(*keys).agg(
        F.count("spi").alias("n"), F.avg("spi").alias("mean"), F.stddev("spi").alias("std"), F.min("spi").alias("min"), F.max("spi").alias("max"), F.median("spi").alias("median"),
        share(v < -1).alias("pct_below_1"), share(v < -2).alias("pct_below_2"), share(v > 1).alias("pct_above_1"), share(v > 2).alias("pct_above_2"), F.avg(base).alias("base_mean"), F.stddev(base).alias("base_std"),
    )
    return stats.withColumn("mean_ok", F.abs("base_mean") < 0.3).withColumn("std_ok", F.col("base_std").between(0.7, 1.3))


def full_years(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """The months of each series from its first January to its last December, with contiguous: whether none between is missing."""
    ends = monthly.groupBy(*keys).agg(F.min("month").alias("a__"), F.max("month").alias("b__"))
    first = F.when(F.month("a__") == 1, F.col("a__")).otherwise(F.add_months(F.trunc("a__", "YEAR"), 12))
    last = F.when(F.month("b__") == 12, F.col("b__")).otherwise(F.add_months(F.trunc("b__", "YEAR"), -1))
    inside = monthly.join(ends.select(*keys, first.alias("a__"), last.alias("b__")), keys).where(F.col("month").between(F.col("a__"), F.col("b__")))
    held = inside.groupBy(*keys).agg((F.count_distinct("month") == F.months_between(F.first("b__"), F.first("a__")) + 1).alias("contiguous"))
    return inside.drop("a__", "b__").join(held, keys)


def spliced(monthly: DataFrame, unit: list[str], scale: int, value: str = "total", least: int = 24) -> DataFrame:
    """unit, scenario, month, acc, contiguous: trailing sums over ``scale`` months for the adapter.

    Series are cut to full years, missing values are 0. A scenario goes on from
    the unit's historical series: months between them are 0, sums run across the
    seam, and its first scale - 1 months are null. A series of fewer than
    ``least`` valid sums has none.
    """
    keys = [*unit, "scenario"]
    rows = full_years(monthly, keys).withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    own = rows.groupBy(*keys).agg(F.min("month").alias("begin__"), F.max("month").alias("end__"), F.first("contiguous").alias("contiguous"))
    past = own.where("scenario = 'historical'").select(*unit, F.col("begin__").alias("past__"))
    spans = own.join(past, unit, "left").withColumn("from__", F.least(F.coalesce("past__", "begin__"), F.col("begin__")))
    spine = spans.select(*keys, "begin__", "contiguous", F.explode(F.sequence("from__", "end__", F.expr("interval 1 month"))).alias("month"))
    known = rows.select(*keys, "month", F.col(value).alias("own__"))
    before = rows.where("scenario = 'historical'").select(*unit, "month", F.col(value).alias("before__"))
    filled = spine.join(known, [*keys, "month"], "left").join(before, [*unit, "month"], "left").withColumn(value, F.coalesce("own__", "before__", F.lit(0.0)))
    acc = accumulate(filled, keys, scale, value).where(F.col("month") >= F.col("begin__"))
    young = (F.col("scenario") != "historical") & (F.months_between("month", "begin__") < scale - 1)
    acc = acc.withColumn("acc", F.when(~young, F.col("acc")))
    enough = F.count("acc").over(Window.partitionBy(*keys)) >= least
    return acc.select(*keys, "month", F.when(enough & F.col("contiguous"), F.col("acc")).alias("acc"), "contiguous")
