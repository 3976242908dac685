"""Connected components by repeated contraction."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm._common import cut, spread


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), both long -> (node, root): root is the smallest node reached, itself included.

    Each round gives every node the neighbour (or itself) of the lowest random
    priority as parent and replaces edges by the edges between parents. A
    constant share of the nodes goes in each round, whatever the shape of the
    graph, and a hub is only a key of a pre-aggregated minimum and of joins that
    adaptive execution can split. Self loops, repeated edges and nulls are
    ignored; a node without an edge to another isn't returned.
    """
    live = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    names = None
    for turn in itertools.count():
        if live.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("v"))
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(
            both.groupBy("a").agg(F.min(rank("b")).alias("m"))
            .select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("up")),
            "parents",
        )
        pa, pb = (parent.select(F.col("node").alias(c), F.col("up").alias(f"p{c}")) for c in "ab")
        live = cut(
            live.join(pa, "a").select("b", "pa").join(pb, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "edges",
        )
        if names is None:
            names = parent.select("node", F.col("up").alias("root"))
        else:
            names = cut(
                names.join(parent.select(F.col("node").alias("root"), "up"), "root", "left")
                .select("node", F.coalesce("up", "root").alias("root")),
                "names",
            )
    if names is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = names.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("low"))
    return names.join(spread(least), "root").select("node", F.col("low").alias("root"))
