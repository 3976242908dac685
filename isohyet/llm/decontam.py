"""Benchmark decontamination by typed templates."""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm._common import cut, small_batches

#: Units of measure, read as such only after a number. Fixed values.
UNITS = frozenset(
    "% $ € £ a bits bytes c celsius cents cm days dollars eur euros f fahrenheit feet ft g gb gram grams h hours hz in inches j kb kelvin kg khz km kmh "
    "kw kwh l lb lbs liter liters litre litres m mb meter meters metre metres mg mhz mi miles min minutes ml mm months mph ms oz pounds s seconds sec "
    "tb tons usd v volts w watts weeks yards years yd".split()
)
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
GLUED = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_]+|[%$€£])")
EDGES = "\"'`.,;:!?()[]{}<>«»“”‘’*#&$%€£|~^_=/\\-+@…¿¡"
TYPES = ("<num>", "<name>", "<unit>")
MIX = np.uint64(0x9E3779B97F4A7C15)


def canonical(text: str | None) -> tuple[list[str], dict[int, tuple[str, str]]]:
    """Template tokens of a text, and the slots: place -> (type, value in lower case).

    A token is a run without white space, stripped of marks at its ends and put
    in lower case; tokens of marks only are left out. Numbers become <num>,
    units after a number <unit>, and capitalised words that don't begin a
    sentence or line <name>.
    """
    tokens, slots, after = [], {}, True

    def slot(kind, value):
        slots[len(tokens)] = (kind, value)
        tokens.append(kind)

    for line in (text or "").split("\n"):
        after = True
        for raw in line.split():
            core = raw.strip(EDGES)
            number = bool(tokens) and tokens[-1] == "<num>" and len(tokens) - 1 in slots
            if not core:
                if number and raw in UNITS:
                    slot("<unit>", raw)
                after = after or raw[-1] in ".!?:"
                continue
            first = core[0]
            if first.isdigit() and NUMBER.fullmatch(core):
                slot("<num>", core)
                if raw[-1] in "%$€£":
                    slot("<unit>", raw[-1])
            elif first.isdigit() and (glued := GLUED.fullmatch(core)) and glued[2].lower() in UNITS:
                slot("<num>", glued[1])
                slot("<unit>", glued[2].lower())
            else:
                low = core.lower()
                if number and low in UNITS:
                    slot("<unit>", low)
                elif not after and first.isupper() and core != core.upper():
                    slot("<name>", low)
                else:
                    tokens.append(low)
            after = raw[-1] in ".!?:"
    return tokens, slots


def windows(tokens: list[str], width: int, cache: dict[str, int]) -> np.ndarray:
    """64-bit hash of each window of ``width`` tokens; a shorter text has none."""
    if len(tokens) < width:
        return np.empty(0, np.uint64)
    if len(cache) > 500_000:
        cache.clear()
    for t in set(tokens).difference(cache):
        cache[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[i : i + n]
    return out


def template_windows(frame: DataFrame, id_col: str, text_col: str, width: int, only=None, lengths: list[int] | None = None) -> DataFrame:
    """(id, at, hash, window, slots, size) for each window, as template and, where it has slots, once more by its words in lower case, without slots.

    window is the hash of the template in both. Windows have each of the
    ``lengths``; where none are given, ``width`` or the whole of a shorter text.
    A window that holds nothing but slots says nothing as a template and comes by
    its words alone: five numbers in a row stand in every table of figures.
    ``only``: a broadcast sorted
    array of the hashes that matter.
    """
    schema = T.StructType([T.StructField("id", frame.schema[id_col].dataType), T.StructField("at", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("window", T.LongType()), T.StructField("slots", T.ArrayType(T.StringType())), T.StructField("size", T.IntegerType())])

    def run(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            ids, at, hashes, names, values, sizes = [], [], [], [], [], []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens, slots = canonical(text)
                words = list(tokens)
                for j, (_, value) in slots.items():
                    words[j] = value.lower()
                held = np.zeros(len(tokens) + 1, np.int64)
                held[[j + 1 for j in slots]] = 1
                held = np.cumsum(held)
                for k in lengths or [min(width, len(tokens)) or width]:
                    typed = windows(tokens, k, cache)
                    n_slots = held[k:] - held[:-k] if len(typed) else typed
                    plain = windows(words, k, cache) if slots else typed
                    for h, ok, literal in ((typed, n_slots < k, False), (plain, n_slots > 0, True)):
                        if only is not None:
                            ok = ok & (only.value[np.minimum(np.searchsorted(only.value, h), len(only.value) - 1)] == h) if len(only.value) else np.zeros(len(h), bool)
                        keep = np.flatnonzero(ok)
                        for i in keep.tolist():
                            ids.append(one)
                            at.append(i)
                            values.append([] if literal else [f"{kind}{value}" for j in range(i, i + k) if j in slots for kind, value in (slots[j],)])
                        hashes += h[keep].view(np.int64).tolist()
                        names += typed[keep].view(np.int64).tolist()
                        sizes += [k] * len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(at, pa.int64()), pa.array(hashes, pa.int64()), pa.array(names, pa.int64()), pa.array(values, pa.list_(pa.string())), pa.array(sizes, pa.int32())], names=schema.names)

    return frame.select(id_col, text_col).mapInArrow(run, schema)


def agreeing(met: DataFrame) -> DataFrame:
    """(id, item, n_pairs, windows) for each document, item and offset: the windows whose slots follow the map that most windows agree on.

    The map is one to one: pairs of values are taken in the order of the windows
    that hold them, pairs of equal values first among ties.
    """
    schema = T.StructType([met.schema["id"], met.schema["item"], T.StructField("n_pairs", T.LongType()), T.StructField("windows", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            counts, kept = [], []
            for rows in batch.column("rows").to_pylist():
                pairs = [(r["window"], set(zip(r["slots"], r["item_slots"]))) for r in rows]
                seen = Counter(p for _, ps in pairs for p in ps)
                theirs, ours = {}, {}
                for p in sorted(seen, key=lambda p: (-seen[p], p[0] != p[1], p)):
                    if p[0] not in theirs and p[1] not in ours:
                        theirs[p[0]], ours[p[1]] = p[1], p[0]
                kept.append(list({w for w, ps in pairs if all(theirs.get(a) == b for a, b in ps)}))
                counts.append(len(theirs))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("item"), pa.array(counts, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=schema.names)

    rows = met.groupBy("id", "item", "shift").agg(F.collect_set(F.struct("item_at", "window", "slots", "item_slots")).alias("rows"))
    return rows.select("id", "item", "rows").mapInArrow(run, schema)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """(id_col, item_col, n_windows, n_matched, n_slots, similarity) for each document that holds a benchmark item.

    Documents and items become template tokens (see canonical) and windows of
    ``width`` tokens, joined by hash; a window with slots also joins by its words
    in lower case, so that a copy is found whatever its capitals and line ends.
    Matches of one document, item and offset count if their slots agree with the
    one-to-one map of values that most of its windows hold, so that an item with
    other numbers or names is found but not a chance mixture; a match by words
    always counts. A document holds an item if at least ``similarity`` of the
    item's distinct windows match. So it matches one of any 1 - similarity of them
    and one more: those that the documents hold least often name the candidates,
    and windows that stand everywhere are only looked at for candidates. An item shorter than a window is one window
    of its own length, searched in documents of any length; if it has nothing
    but slots, by its words.

    Rows with a null id are one document, and so are rows of one id; a null item id
    is an item like any other. Other columns are left alone, whatever their names.

    Hashes of the items go to the tasks if they are at most broadcast_rows,
    which keeps other windows out of the shuffle; else all windows are joined.
    Null or empty texts hold nothing; null ids are carried; repeated rows of an
    id count as one document; items of one text are all reported. Empty tables
    give an empty result.
    """
    small_batches(docs.sparkSession)
    ours = cut(template_windows(benchmark, item_col, item_text, width), "item-windows").select(F.col("id").alias("item"), F.col("at").alias("item_at"), "hash", "window", F.col("slots").alias("item_slots"), "size")
    sizes = ours.groupBy(F.col("item").alias("held")).agg(F.count_distinct("window").alias("n_windows"))
    lengths = sorted(r["size"] for r in ours.select("size").distinct().collect()) or [width]
    only = None
    if ours.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hashes = ours.select("hash").distinct().toArrow().column(0).to_numpy()
        only = docs.sparkSession.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))
    theirs = template_windows(docs, id_col, text_col, width, only, lengths).select("id", "at", "hash", "slots")
    if only is None:
        theirs = theirs.join(ours.select("hash").distinct(), "hash", "left_semi")
    theirs = cut(theirs, "document-windows")
    # how often documents hold each window, by template or by words
    seen = theirs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    often = ours.select("item", "window", "hash").distinct().join(seen, "hash", "left").groupBy("item", "window").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    by_count = Window.partitionBy("item").orderBy("n", "window")
    rare = often.withColumn("place", F.row_number().over(by_count)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("item")))
    rare = rare.where(F.col("place") <= F.floor((1 - F.lit(similarity)) * F.col("of") + 1e-9) + 1).select("item", "window")
    keyed = lambda c: F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v"))  # noqa: E731  null ids and items are keys as well
    sought = ours.withColumn("item_key", keyed("item"))
    named = cut(
        theirs.join(sought.join(rare.withColumn("item_key", keyed("item")).drop("item"), ["item_key", "window"]).select("hash", "item_key").distinct(), "hash")
        .select(keyed("id").alias("id_key"), "item_key").distinct(),
        "candidates",
    )
    met = theirs.withColumn("id_key", keyed("id")).join(named, "id_key").join(sought, ["hash", "item_key"]).select("id", "item", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "window", "slots", "item_slots")
    agreed = agreeing(met)
    found = agreed.select("id", "item", "n_pairs", F.explode("windows").alias("window")).groupBy("id", "item").agg(F.count_distinct("window").alias("n_matched"), F.max("n_pairs").alias("n_slots"))
    return (
        found.join(sizes, F.col("item").eqNullSafe(F.col("held")))
        .where(F.col("n_matched") >= F.lit(similarity) * F.col("n_windows"))
        .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "n_matched", "n_slots", (F.col("n_matched") / F.col("n_windows")).alias("similarity"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a benchmark item.

    Repeated rows of an id go or stay together. Rows with a null id are told
    apart by their texts: those whose text holds an item go, the others stay.
    """
    gone = leaks(docs.where(F.col(id_col).isNotNull()), benchmark, id_col, text_col, **options).select(id_col).distinct()
    known = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti").select(*docs.columns)
    nameless = docs.where(F.col(id_col).isNull())
    key = f"digest_{uuid.uuid4().hex}"
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    bad = leaks(nameless.select(digest.alias(key), text_col), benchmark, key, text_col, **options).select(key).distinct()
    return known.unionByName(nameless.withColumn(key, digest).join(bad, key, "left_anti").select(*docs.columns))
