"""Ranks over a whole table and exact quantiles of large groups, without a task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.sources.io import scratch


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back, as several jobs go on from it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rank(rows: DataFrame, order: Column, descending: bool = True, rank: str = "rank", total: str = "total") -> DataFrame:
    """rows with the rank of ``order`` among all rows (1 is first, ties take the best place) and how many have one; without a value there is no rank.

    Equal values are counted before anything is shuffled, so a value that many
    rows share is one row. The distinct ones are dealt out by range and written;
    a value's rank is the number of rows in the ranges in front of its own, which
    are as many as there are partitions, and of those in front of it there.
    """
    valued = rows.withColumn("order__", order)
    counts = valued.where("order__ is not null").groupBy("order__").agg(F.count(F.lit(1)).alias("n__"))
    by = F.col("order__").desc() if descending else F.col("order__").asc()
    ranged = written(counts.repartitionByRange(by).withColumn("part__", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("part__").agg(F.sum("n__").alias("n")).agg(F.collect_list(F.struct("part__", "n")).alias("parts__"))
    add = lambda total, x: total + x["n"]
    zero = F.lit(0).cast("long")
    before = F.aggregate(F.filter("parts__", lambda x: x["part__"] < F.col("part__")), zero, add)
    here = Window.partitionBy("part__").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranged.withColumn("here__", F.coalesce(F.sum("n__").over(here), zero)).crossJoin(F.broadcast(parts))
    ranks = ranks.select("order__", (before + F.col("here__") + 1).alias(rank), F.aggregate("parts__", zero, add).alias(total))
    return valued.join(ranks, "order__", "left").select(*rows.columns, rank, total)


def _scale(v: Column) -> Column:
    """A whole number that never falls as v grows: the sign and a sixteenth of an octave."""
    size = F.floor(F.log2(F.abs(v)) * 16) + 20_000  # above 0 for every double
    far = F.lit(50_000).cast("long")
    return F.when(v == 0, F.lit(0).cast("long")).when(F.abs(v) == float("inf"), F.when(v > 0, far).otherwise(-far)).when(v > 0, size).otherwise(-size)


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], most: int = 100_000, cells: int = 1024) -> DataFrame:
    """keys, n, lowest, highest and for each name the quantile of its share, interpolated as ``percentile`` does; nulls and NaN don't count.

    Selection by histograms: values are counted by sign and size (a sixteenth of
    an octave); only the cell that holds a wanted rank goes on, in ``cells`` equal
    parts, until it has at most ``most`` values or all of them are equal. Only
    then are the values of a cell put in order. Counts are summed before they are
    shuffled, so no task holds a group; a level takes ten bits, so there are a few
    at most.
    """
    on = [F.col(k) for k in keys]
    v = written(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*on, F.col(value).cast("double").alias("v__")).withColumn("cell__", _scale(F.col("v__"))), "values")
    first = written(v.groupBy(*keys, "cell__").agg(F.count(F.lit(1)).alias("n"), F.min("v__").alias("a"), F.max("v__").alias("b")), "histogram")
    sizes = first.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("a").alias("lowest"), F.max("b").alias("highest"))
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in wanted.values()])))
    targets = sizes.select(*keys, F.explode(ranks).alias("rank__"))

    def picked(histogram: DataFrame, inner: list[str]) -> DataFrame:
        """The cells that hold a target: keys, cell__, a, b, n, before__, rank__."""
        order = Window.partitionBy(*keys, *inner).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
        placed = histogram.withColumn("before__", F.coalesce(F.col("start__") if inner else F.lit(0), F.lit(0)) + F.coalesce(F.sum("n").over(order), F.lit(0)))
        met = placed.join(targets, keys) if keys else placed.crossJoin(F.broadcast(targets))
        met = met.where((F.col("rank__") >= F.col("before__")) & (F.col("rank__") < F.col("before__") + F.col("n")))
        return met.select(*keys, "cell__", "a", "b", "n", F.col("before__").cast("long").alias("before__"), "rank__")

    def inside(cells_: DataFrame) -> DataFrame:
        """The values of cells, each cell once: keys, cell__, a, b, start__, v__."""
        once = cells_.select(*keys, "cell__", "a", "b", F.col("before__").alias("start__")).distinct()
        return v.join(once, [*keys, "cell__"]).where(F.col("v__").between(F.col("a"), F.col("b")))

    now = written(picked(first, []), "cells")
    settled = None
    while True:
        small = (F.col("n") <= most) | (F.col("a") == F.col("b"))
        done = now.where(small)
        settled = done if settled is None else settled.unionByName(done)
        large = now.where(~small)
        if large.isEmpty():
            break
        part = F.least(F.floor((F.col("v__") - F.col("a")) / (F.col("b") - F.col("a")) * cells), F.lit(cells - 1))
        finer = inside(large).groupBy(*keys, "cell__", F.col("a").alias("a0"), "start__", part.alias("part__")).agg(F.count(F.lit(1)).alias("n"), F.min("v__").alias("a"), F.max("v__").alias("b"))
        now = written(picked(finer, ["cell__", "a0"]), "cells")
    equal = settled.where("a = b").select(*keys, "rank__", F.col("a").alias("x"))
    apart = settled.where("a < b")
    listed = inside(apart).groupBy(*keys, "cell__", "a", "b").agg(F.sort_array(F.collect_list("v__")).alias("vs"))
    found = apart.join(listed, [*keys, "cell__", "a", "b"]).select(*keys, "rank__", F.get("vs", (F.col("rank__") - F.col("before__")).cast("int")).alias("x"))
    held = equal.unionByName(found).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank__", "x"))).alias("at__"))
    out = sizes.join(held, keys) if keys else sizes.crossJoin(F.broadcast(held))

    def quantile(q: float) -> Column:
        p = place(q)
        low, high = F.floor(p), F.ceil(p)
        x, y = F.col("at__")[low], F.col("at__")[high]
        return F.when((low == high) | (x == y), x).otherwise((high - p) * x + (p - low) * y)

    return out.select(*keys, "n", "lowest", "highest", *[quantile(q).alias(name) for name, q in wanted.items()])
