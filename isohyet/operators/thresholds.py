"""Thresholds from a baseline: by day of the year and of the whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.special import let
from isohyet.functions.units import doy_noleap


def nearest_quantile(value: str, q: float) -> Column:
    """The value at rank rint((n - 1) q), half to even; exact, over a group that collect_list may hold (a baseline of one series)."""
    ordered = F.sort_array(F.collect_list(value))
    return F.element_at(ordered, (F.rint((F.size(ordered) - 1) * F.lit(q)) + 1).cast("int"))


def filter_baseline(days: DataFrame, keys: list[str], first: int, last: int, strict: bool = True) -> DataFrame:
    """Days of the baseline years. Not strict: a series without any keeps all its days."""
    inside = F.col("year").between(first, last)
    if strict:
        return days.where(inside)
    some = days.groupBy(*keys).agg(F.max(inside).alias("some__"))
    return days.join(some, keys).where(inside | ~F.col("some__")).drop("some__")


def doy_arrays(base: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], window: int = 5, date: str = "date") -> DataFrame:
    """keys, and for each name -> (value, q) an array of 365 thresholds: the nearest quantile over all baseline days within the window around each day of the year, around the year's end as well; null where there are none.

    Baseline days are shuffled once, by series: there, each day of the year has
    its values in order, neighbours' are merged for every window, and all
    quantiles of a value come from that one structure. A series is a row then,
    of as many values as its baseline has days.
    """
    half = window // 2
    values = sorted({v for v, _ in wanted.values()})
    days = base.select(*keys, *values, doy_noleap(F.col(date)).alias("doy")).where("doy is not null").repartition(*keys)
    daily = days.groupBy(*keys, "doy").agg(*[F.sort_array(F.collect_list(v)).alias(v) for v in values])
    series = daily.groupBy(*keys).agg(F.collect_list(F.struct("doy", *values)).alias("days__"))
    year = F.sequence(F.lit(1), F.lit(365))

    def in_windows(own: Column) -> Column:
        near = lambda d: F.array(*[F.get(own, F.pmod(d - 1 + o, F.lit(365))) for o in range(-half, half + 1)])
        return F.transform(year, lambda d: F.sort_array(F.flatten(F.filter(near(d), lambda x: x.isNotNull()))))

    def quantiles(value: str) -> Column:
        """struct of the names of a value; each step is bound once, so that no optimizer rule repeats it."""
        at = lambda q: lambda x: F.get(x, F.rint((F.size(x) - 1) * F.lit(q)).cast("int"))
        picked = lambda w: F.struct(*[F.transform(w, at(q)).alias(name) for name, (v, q) in wanted.items() if v == value])
        own = lambda doys: F.transform(year, lambda d: F.get("days__", F.array_position(doys, d).cast("int") - 1)[value])
        return let(F.transform("days__", lambda x: x["doy"]), lambda doys: let(own(doys), lambda o: let(in_windows(o), picked)))

    made = series.select(*keys, *[quantiles(v).alias(v) for v in values])
    return made.select(*keys, *[F.col(v)[name].alias(name) for name, (v, _) in wanted.items()])


def doy_thresholds(base: DataFrame, keys: list[str], value: str, q: float, window: int = 5, date: str = "date", name: str = "threshold") -> DataFrame:
    """keys, doy, threshold: doy_arrays of one quantile, a row for each day of the year that has one."""
    arrays = doy_arrays(base, keys, {"t__": (value, q)}, window, date)
    each = F.transform("t__", lambda t, i: F.struct((i + 1).cast("int").alias("doy"), t.alias(name)))
    return arrays.select(*keys, F.inline(F.filter(each, lambda x: x[name].isNotNull())))


def attach_arrays(days: DataFrame, arrays: DataFrame, keys: list[str], names: list[str], date: str = "date") -> DataFrame:
    """Days of a no-leap calendar with the thresholds of their day of the year (null where there is none), and known__: whether their series has a baseline."""
    dated = days.withColumn("doy", doy_noleap(F.col(date))).where("doy is not null")
    met = dated.join(arrays.withColumn("known__", F.lit(True)), keys, "left")
    return met.select(*dated.columns, *[F.get(n, F.col("doy") - 1).alias(n) for n in names], F.coalesce("known__", F.lit(False)).alias("known__"))


def doy_smooth(thresholds: DataFrame, keys: list[str], name: str = "threshold", width: int = 3) -> DataFrame:
    """Circular centred mean over ``width`` days of the year; null where a day of the window has none."""
    half = width // 2
    near = thresholds.select(*keys, F.col(name), F.explode(F.array(*[F.pmod(F.col("doy") - 1 + o, F.lit(365)) + 1 for o in range(-half, half + 1)])).alias("doy"))
    return near.groupBy(*keys, "doy").agg(F.when(F.count(name) == width, F.avg(name)).alias(name))


def doy_means(base: DataFrame, keys: list[str], value: str, date: str = "date", plus: float = 5.0, least: float = 313.15, name: str = "threshold") -> DataFrame:
    """Baseline mean of each day of the year plus a difference, but not below a fixed floor."""
    return base.withColumn("doy", doy_noleap(F.col(date))).where("doy is not null").groupBy(*keys, "doy").agg(F.greatest(F.avg(value) + plus, F.lit(least)).alias(name))


def attach(days: DataFrame, thresholds: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Days of a no-leap calendar with the threshold of their day of the year (null where there is none)."""
    return days.withColumn("doy", doy_noleap(F.col(date))).where("doy is not null").join(thresholds, [*keys, "doy"], "left")
