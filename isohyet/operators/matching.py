"""Matching of names by tiers, and merging of tables on them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.functions.names import alias_name, normalize_name
from isohyet.operators.order_stats import written


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio: not a Levenshtein score, so no builtin gives it."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def alike(left: DataFrame, right: DataFrame, block: list[str], cutoff: float) -> DataFrame:
    """Pairs (block, a, unit, b) that may reach the cutoff, and left's own ``least``: no other pair can.

    difflib's ratio is at most twice the shorter length by the sum of both, so
    lengths must fit. Above a cutoff of 2/3, long names that reach it have two
    equal letters in a row in common (matching parts are fewer than matching
    letters): they meet by bigrams. Short names, and all at lower cutoffs, meet by lengths.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    both = [*block, "a", "least", "unit", "b"]
    by_gram = left.withColumn("g__", F.explode(grams("a"))).join(right.withColumn("g__", F.explode(grams("b"))), [*block, "g__"]).select(*both)
    short = 1 / (1.5 * cutoff - 1) if cutoff > 2 / 3 else None
    small = lambda rows, c: rows if short is None else rows.where(F.length(c) <= F.lit(short))
    least, most = F.ceil(F.length("a") * cutoff / (2 - cutoff) - 1e-9), F.floor(F.length("a") * (2 - cutoff) / cutoff + 1e-9)
    sized = small(left, "a").where("a <> ''").withColumn("n__", F.explode(F.sequence(least, most)))
    by_size = sized.join(small(right, "b").withColumn("n__", F.length("b").cast("long")), [*block, "n__"]).select(*both)
    common = F.aggregate(
        F.array_distinct(F.split("a", "")), F.lit(0),
        lambda n, c: n + F.least(F.length("a") - F.length(F.replace("a", c, F.lit(""))), F.length("b") - F.length(F.replace("b", c, F.lit("")))),
    )
    return by_gram.unionByName(by_size).distinct().where(2 * common >= F.greatest(F.lit(cutoff), "least") * (F.length("a") + F.length("b")))


def _sizes(rows: DataFrame, block: list[str], name: str) -> DataFrame:
    """(block, sizes__): the lengths of a block's names."""
    return rows.where(F.col(name) != "").groupBy(*block).agg(F.collect_set(F.length(name)).alias("sizes__"))


def contained(left: DataFrame, right: DataFrame, block: list[str]) -> DataFrame:
    """(block, a, unit) of names that contain a unit or stand in one, the first unit by name: parts of names, of the lengths that the other side has, meet as keys."""
    part = lambda c: F.array_distinct(F.flatten(F.transform(
        F.filter("sizes__", lambda n: n <= F.length(c)), lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))))
    holds = left.join(_sizes(right, block, "b"), block).select(*block, "a", F.explode(part("a")).alias("b")).join(right, [*block, "b"]).select(*block, "a", "unit")
    parts = right.join(_sizes(left, block, "a"), block).select(*block, "unit", F.explode(part("b")).alias("a")).groupBy(*block, "a").agg(F.min("unit").alias("unit"))
    return holds.unionByName(left.join(parts, [*block, "a"]).select(*block, "a", "unit")).groupBy(*block, "a").agg(F.min("unit").alias("unit"))


def _without(name: str, k: int) -> Column:
    """Hashes of a name and of what is left of it without up to k of its characters."""
    left = F.array(name)
    for _ in range(k):
        shorter = F.transform(left, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))
        left = F.array_union(left, F.flatten(shorter))
    return F.transform(left, lambda x: F.xxhash64(x))


def _near(left: DataFrame, right: DataFrame, block: list[str], k: int, cutoff: float) -> DataFrame:
    """left (block, a, sizes__) with its best unit and score among names that are equal without up to k characters of each, and whether no other name can be as good.

    difflib's matching parts are a common subsequence. A name of n letters that
    isn't met lacks more than k of the longer one's letters in it, so its ratio is
    bounded by both lengths.
    """
    keys = [*block, "a"]
    met = left.select(*keys, F.explode(_without("a", k)).alias("h__")).join(right.select(*block, "b", "unit", F.explode(_without("b", k)).alias("h__")), [*block, "h__"])
    scored = met.select(*keys, "b", "unit").distinct().withColumn("score", similarity("a", "b")).where(F.col("score") >= cutoff)
    best = scored.groupBy(*keys).agg(F.max("score").alias("score"), F.min_by("unit", F.struct(-F.col("score"), F.col("unit"))).alias("unit"))
    size = F.length("a")
    other = lambda n: 2.0 * F.greatest(F.least(size, n, F.greatest(size, n) - (k + 1)), F.lit(0)) / (size + n)
    bound = F.array_max(F.transform("sizes__", other))
    return left.drop("unit", "score").join(best, keys, "left").withColumn("settled__", (bound < cutoff) | F.coalesce(F.col("score") > bound, F.lit(False)))


def _fuzzy(left: DataFrame, right: DataFrame, block: list[str], cutoff: float) -> DataFrame:
    """(block, a, unit) of the unit of the best ratio from the cutoff on, the first by name of equals.

    Names that are equal without one or two characters of each meet first, at a
    cost that grows with the names; only those that could still have a better or
    equal unit go on, in the end to all names that alike() leaves.
    """
    keys, found = [*block, "a"], None
    rest = left.where("a <> ''").join(_sizes(right, block, "b"), block)
    for k in (1, 2):
        now = written(_near(rest, right, block, k, cutoff), "near-names")
        done = now.where("settled__ and unit is not null").select(*keys, "unit")
        found = done if found is None else found.unionByName(done)
        rest = now.where("not settled__")
        if rest.isEmpty():
            return found
    scored = alike(rest.select(*keys, F.coalesce("score", F.lit(0.0)).alias("least")), right, block, cutoff).withColumn("score", similarity("a", "b")).where(F.col("score") >= cutoff)
    return found.unionByName(scored.groupBy(*keys).agg(F.min_by("unit", F.struct(-F.col("score"), F.col("unit"))).alias("unit")))


def match_names(items: DataFrame, units: DataFrame, item: str, unit: str, block: list[str], cutoff: float = 0.7, aliases: dict[str, str] | None = None) -> DataFrame:
    """(block, item, unit, tier) of each item's best unit within its block: equal names or aliases (0), one contains the other (1), alike by difflib (2).

    Each tier looks only at names that the ones before leave, and names meet by
    keys (parts of them, or what is left without some characters) where these
    decide. The first unit by name wins ties; items without a match have a null unit.
    """
    left = items.select(*block, F.col(item).alias("item"), alias_name(F.col(item), aliases or {}).alias("a")).distinct()
    right = units.select(*block, F.col(unit).alias("unit"), alias_name(F.col(unit), aliases or {}).alias("b")).where("b is not null").groupBy(*block, "b").agg(F.min("unit").alias("unit"))
    keys = [*block, "a"]
    right = written(right, "units")
    asked = left.where("a is not null").select(*keys).distinct().join(right.withColumnRenamed("b", "a"), keys, "left")
    equal = written(asked, "equal-names")
    rest = equal.where("unit is null").select(*keys)
    inside = written(contained(rest, right, block), "contained-names")
    rest = rest.join(inside, keys, "left_anti")
    of = lambda rows, tier: rows.select(*keys, "unit", F.lit(tier).alias("tier"))
    best = of(equal.where("unit is not null"), 0).unionByName(of(inside, 1)).unionByName(of(_fuzzy(rest, right, block, cutoff), 2))
    return left.join(best, keys, "left").select(*block, "item", "unit", "tier")


def portfolio_states(rows: DataFrame, state: str, place: str, fallback: str) -> DataFrame:
    """(state_key, state) of a portfolio: states whatever their case, in the spelling that comes first; "All" is none of them. An empty portfolio gives the fallback."""
    key = F.lower(F.trim(F.col(state)))
    held = rows.where(F.col(state).isNotNull() & (key != "all")).groupBy(key.alias("state_key")).agg(F.min_by(state, place).alias("state"))
    one = rows.sparkSession.range(1).select(F.lower(F.lit(fallback)).alias("state_key"), F.lit(fallback).alias("state"))
    return held.unionByName(one.join(held.agg(F.count(F.lit(1)).alias("n")).where("n > 0"), F.lit(True), "left_anti"))


def merge_master(boundaries: DataFrame, master: DataFrame, state: str, name: str, aliases: dict[str, str] | None = None, with_state: bool = True, block: str | None = None) -> DataFrame:
    """Boundaries of the master's states with its columns joined on the normalised district, or on district and block where ``block`` names the boundaries' column; columns of both get _csv on the master's side.

    with_state=False joins on the district alone: same-named districts of two
    states then multiply rows.
    """
    key = lambda c: alias_name(F.col(c), aliases or {})
    unit = lambda d, b: F.concat_ws("|", key(d), key(b)) if block else key(d)
    left = boundaries.withColumn("s__", normalize_name(F.col(state))).withColumn("k__", unit(name, block))
    right = master.withColumn("s__", normalize_name(F.col("state"))).withColumn("k__", unit("district", "block"))
    right = right.withColumnsRenamed({c: f"{c}_csv" for c in master.columns if c in boundaries.columns})
    inside = left.join(right.select("s__").distinct(), "s__", "left_semi")
    return inside.join(right if with_state else right.drop("s__"), ["s__", "k__"] if with_state else "k__", "left").drop("s__", "k__")


def filter_state(rows: DataFrame, column: str, wanted: str, synonyms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows of a state by its folded name or a synonym."""
    names = [wanted, *(synonyms or {}).get(wanted.strip().lower(), ())]
    plain: list[Column] = [normalize_name(F.lit(n)) for n in names]
    return rows.where(normalize_name(F.col(column)).isin(*plain))
