"""Ranks, percentiles and positions within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.operators.order_stats import exact_quantiles

PLACES = 9  # values that agree to so many places are ties: averages of the same numbers differ in their last bits by the order of summation


def tied(value: str) -> Column:
    return F.round(F.col(value), PLACES)


def rank_in_group(rows: DataFrame, group: list[str], value: str = "value", higher_is_worse: bool = True) -> DataFrame:
    """rank (1 is worst, ties take the best place) and percentile (max method, higher is worse); rows without a value have neither."""
    known = F.col(value).isNotNull()
    part = Window.partitionBy(*group, known)
    order = part.orderBy(tied(value).desc() if higher_is_worse else tied(value).asc())
    back = part.orderBy(tied(value).asc() if higher_is_worse else tied(value).desc()).rangeBetween(Window.unboundedPreceding, 0)
    n = F.count(value).over(part)
    return rows.withColumn("rank", F.when(known, F.rank().over(order))).withColumn("percentile", F.when(known, F.count(value).over(back) / n * 100))


def rankings_table(rows: DataFrame, group: list[str], value: str = "value", delta: str = "delta") -> DataFrame:
    """rank_value (descending, min), percentile (average method), rank_delta; the direction of the metric plays no part."""
    known = F.col(value).isNotNull()
    part = Window.partitionBy(*group, known)
    up = part.orderBy(tied(value).asc())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, tied(value)))
    both = Window.partitionBy(*group, F.col(delta).isNotNull()).orderBy(tied(delta).desc())
    return (
        rows.withColumn("rank_value", F.when(known, F.rank().over(part.orderBy(tied(value).desc()))))
        .withColumn("percentile", F.when(known, (F.rank().over(up) + (ties - 1) / 2) / F.count(value).over(part) * 100))
        .withColumn("rank_delta", F.when(F.col(delta).isNotNull(), F.rank().over(both)))
    )


def position_stats(rows: DataFrame, group: list[str], value: str = "value", higher_is_worse: bool = True, inclusive: bool = True) -> DataFrame:
    """rank, n and percentile of each value among the group's: from counts of lower, equal and higher values in one window pass."""
    known = F.col(value).isNotNull()
    part = Window.partitionBy(*group, known)
    up = part.orderBy(tied(value))
    n = F.count(value).over(part)
    le = F.count(value).over(up.rangeBetween(Window.unboundedPreceding, 0))
    lt = F.rank().over(up) - 1
    worse = n - le if higher_is_worse else lt
    better = (le if inclusive else lt) if higher_is_worse else (n - lt if inclusive else n - le)
    return rows.select("*", F.when(known, worse + 1).alias("position"), F.when(known, n).alias("n"), F.when(known, better / n * 100).alias("position_percentile"))


def percentile_le_lt(rows: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Share of values at most and below each value, and its descending rank; direction plays no part."""
    part = Window.partitionBy(*group, F.col(value).isNotNull())
    up = part.orderBy(tied(value))
    n = F.count(value).over(part)
    known = F.col(value).isNotNull()
    return rows.select(
        "*", F.when(known, F.count(value).over(up.rangeBetween(Window.unboundedPreceding, 0)) / n * 100).alias("percentile_le"), F.when(known, (F.rank().over(up) - 1) / n * 100).alias("percentile_lt"),
        F.when(known, F.rank().over(part.orderBy(tied(value).desc()))).alias("rank_desc"),
    )


def top_increases(rows: DataFrame, keys: list[str], n: int = 20, delta: str = "delta", value: str = "value") -> DataFrame:
    """The n rows of the greatest increase, or of the greatest value where no row has a baseline; ties by the keys. A limit is what the report asks for."""
    some = rows.agg(F.max(F.col(delta).isNotNull()).alias("some__"))
    by = rows.crossJoin(F.broadcast(some)).withColumn("by__", F.when(F.col("some__"), F.col(delta)).otherwise(F.col(value)))
    return by.where("by__ is not null").orderBy(F.round("by__", PLACES).desc(), *keys).limit(n).drop("by__", "some__")


def robust_range(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """2nd and 98th percentiles of finite values (lo and hi), and vmin and vmax, where a range without extent is padded by max(10 %, 1). Groups may be of any size."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    ends = exact_quantiles(finite, keys, value, {"lo": 0.02, "hi": 0.98})
    pad = F.greatest(F.abs("lo") * 0.1, F.lit(1.0))
    flat = F.col("lo") == F.col("hi")
    return ends.select(*keys, F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")).alias("vmin"), F.when(flat, F.col("hi") + pad).otherwise(F.col("hi")).alias("vmax"), "lowest", "highest", "lo", "hi")


def find_baseline_period(periods: DataFrame, keys: list[str], preferred: tuple[str, ...] = ("1990-2010",)) -> DataFrame:
    """The historical period of each key: the first preferred one that is there (_ and - are the same), else the earliest."""
    plain = F.replace("period", F.lit("_"), F.lit("-"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in preferred]), plain), F.lit(0)), F.lit(len(preferred) + 1))
    return periods.where("scenario = 'historical'").groupBy(*keys).agg(F.min_by("period", F.struct(place, plain)).alias("baseline_period"))


def resolve_metric_columns(long: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (slug, scenario, asked, stat) with the period to use: the one asked for, else the first that contains it, else the first of the metric, scenario and stat; null where there is none."""
    have = long.select("slug", "scenario", "period", "stat").distinct()
    ends = lambda c: [F.regexp_extract(c, r"(\d{4})\D(\d{4})", i).try_cast("int") for i in (1, 2)]
    (first, last), (y0, y1) = ends("period"), ends("asked")
    tier = F.when(F.replace("period", F.lit("_"), F.lit("-")) == F.replace("asked", F.lit("_"), F.lit("-")), 0).when((first <= y0) & (last >= y1), 1).otherwise(2)
    keys = ["slug", "scenario", "asked", "stat"]
    met = requests.distinct().join(have, ["slug", "scenario", "stat"], "left")
    return met.groupBy(*keys).agg(F.min_by("period", F.when(F.col("period").isNotNull(), F.struct(tier, "period"))).alias("period"))


def slider_bounds(ranges: DataFrame, low: str = "vmin", high: str = "vmax", share: float = 0.1) -> DataFrame:
    """ranges with slider_low and slider_high, a share of the range beyond its ends (at least 1 for one without extent)."""
    pad = F.when(F.col(high) > F.col(low), (F.col(high) - F.col(low)) * share).otherwise(F.lit(1.0))
    return ranges.withColumn("slider_low", F.col(low) - pad).withColumn("slider_high", F.col(high) + pad)
