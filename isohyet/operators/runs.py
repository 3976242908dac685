"""Runs of days: islands of a flag over positions, not dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(days: DataFrame, keys: list[str], flag: Column, order: str = "date") -> DataFrame:
    """The flagged days with pos (place among the days present) and island (one number per run). One shuffle and sort by the keys; no self-join."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        days.withColumn("flag__", F.coalesce(flag, F.lit(False)))
        .withColumn("pos", F.row_number().over(w))
        .withColumn("island", F.sum(F.when(F.col("flag__"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where("flag__").drop("flag__")
    )


def run_lengths(days: DataFrame, keys: list[str], flag: Column, order: str = "date") -> DataFrame:
    """keys, island, begin (position), first, last (dates), length of every run."""
    return islands(days, keys, flag, order).groupBy(*keys, "island").agg(F.min("pos").alias("begin"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"))


def run_stats(days: DataFrame, keys: list[str], flag: Column, least: int = 1, order: str = "date") -> DataFrame:
    """keys, n_days, longest, days_in_runs, events over runs of at least ``least`` days; a series without such runs has zeros.

    One window and one grouped pass: an island holds the unflagged day in front of
    it, so every series is there without looking for its keys again.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    on = days.select(*keys, order, F.coalesce(flag, F.lit(False)).alias("on__"))
    numbered = on.withColumn("island", F.sum(F.when(F.col("on__"), 0).otherwise(1)).over(before))
    each = numbered.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"), F.count_if("on__").alias("length"))
    long = F.when((F.col("length") >= least) & (F.col("length") > 0), F.col("length"))
    return each.groupBy(*keys).agg(F.sum("n").alias("n_days"), F.coalesce(F.max(long), F.lit(0)).alias("longest"), F.coalesce(F.sum(long), F.lit(0)).alias("days_in_runs"), F.count(long).alias("events"))


def in_order(order: str, *columns: Column | str) -> Column:
    """Aggregate: the columns of a group's rows as structs in order. For groups of a bounded size, as the days of a year."""
    return F.array_sort(F.collect_list(F.struct(order, *columns)))


def folded_runs(days: Column, flag, least: int) -> Column:
    """struct<longest, days_in_runs, events> of the runs of at least ``least`` elements for which flag holds, in one look at each element."""
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("run"), zero.alias("longest"), zero.alias("days_in_runs"), zero.alias("events"))

    def step(s, day):
        run = F.when(F.coalesce(flag(day), F.lit(False)), s["run"] + 1).otherwise(zero)
        more = F.when(run == least, F.lit(least).cast("long")).when(run > least, F.lit(1).cast("long")).otherwise(zero)
        return F.struct(run.alias("run"), F.when(run >= least, F.greatest(s["longest"], run)).otherwise(s["longest"]).alias("longest"), (s["days_in_runs"] + more).alias("days_in_runs"), (s["events"] + F.when(run == least, F.lit(1).cast("long")).otherwise(zero)).alias("events"))

    return F.aggregate(days, state, step, lambda s: F.struct(s["longest"].alias("longest"), s["days_in_runs"].alias("days_in_runs"), s["events"].alias("events")))


def folded_peak(days: Column, value, limit, least: int) -> Column:
    """struct<magnitude, peak> of the run of at least ``least`` elements at or above the limit with the greatest mean exceedance, the first of equals; nulls without one."""
    none = F.lit(None).cast("double")
    zero = F.lit(0.0)
    state = F.struct(F.lit(0).alias("n"), zero.alias("over"), none.alias("top"), none.alias("magnitude"), none.alias("peak"))
    mean = lambda s: s["over"] / F.nullif(s["n"], F.lit(0))
    better = lambda s: (s["n"] >= least) & (s["magnitude"].isNull() | (mean(s) > s["magnitude"]))
    best = lambda s: [F.when(better(s), mean(s)).otherwise(s["magnitude"]).alias("magnitude"), F.when(better(s), s["top"]).otherwise(s["peak"]).alias("peak")]

    def step(s, day):
        v, t = value(day), limit(day)
        on = F.coalesce(v >= t, F.lit(False))
        goes_on = F.struct((s["n"] + 1).alias("n"), (s["over"] + v - t).alias("over"), F.greatest(s["top"], v).alias("top"), s["magnitude"].alias("magnitude"), s["peak"].alias("peak"))
        ends = F.struct(F.lit(0).alias("n"), zero.alias("over"), none.alias("top"), *best(s))
        return F.when(on, goes_on).otherwise(ends)

    return F.aggregate(days, state, step, lambda s: F.struct(*best(s)))


def spell_list(days: DataFrame, keys: list[str], flag: Column, least: int = 6, order: str = "date") -> DataFrame:
    """keys, begin, positions: the zero-based positions of each run."""
    spells = islands(days, keys, flag, order).groupBy(*keys, "island").agg(F.sort_array(F.collect_list(F.col("pos") - 1)).alias("positions"))
    return spells.where(F.size("positions") >= least).select(*keys, F.col("positions")[0].alias("begin"), "positions")


def hottest_spell(days: DataFrame, keys: list[str], value: str, threshold: str, least: int = 5, order: str = "date", ge: bool = True) -> DataFrame:
    """keys, magnitude (greatest mean exceedance of a spell), peak of that spell; the first spell wins ties."""
    over = F.col(value) >= F.col(threshold) if ge else F.col(value) > F.col(threshold)
    spells = (
        islands(days, keys, over, order).groupBy(*keys, "island")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("begin"), F.avg(F.col(value) - F.col(threshold)).alias("magnitude"), F.max(value).alias("peak"))
        .where(F.col("n") >= least)
    )
    return spells.groupBy(*keys).agg(F.max_by(F.struct("magnitude", "peak"), F.struct("magnitude", -F.col("begin"))).alias("m")).select(*keys, "m.magnitude", "m.peak")


def rolling_sum(days: DataFrame, keys: list[str], value: str, rows: int, order: str, name: str) -> DataFrame:
    """Trailing sum over ``rows`` rows; null until the window is full."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return days.withColumn(name, F.when(F.count(value).over(w) == rows, F.sum(value).over(w)))
