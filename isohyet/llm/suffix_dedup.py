"""Repeated byte strings by merging the sorted suffixes of shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm._common import cut, small_batches, with_fields, without

GRAM = 32  # bytes of an anchor
BLOCK = 1 << 20  # windows looked at in one go
LOW24 = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor key) of each run of windows of ``length`` bytes that share an anchor.

    A window's anchor is the place in it whose GRAM bytes have the lowest hash,
    the first of equals: a choice by content alone. So equal windows have their
    anchors at the same offset, and under the same key.
    """
    found = []
    n = len(data) - length + 1
    for lo in range(0, max(n, 0), BLOCK):
        part = data[lo : min(lo + BLOCK, n) + length - 1].astype(np.uint64)
        h, step, mult = part + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
        while step < GRAM:
            h = h[:-step] * mult + h[step:]
            mult, step = np.uint64(int(mult) * int(mult) & 0xFFFFFFFFFFFFFFFF), step * 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = (h & ~LOW24) | np.arange(len(h), dtype=np.uint64)
        wide, reach = length - GRAM + 1, 1
        while reach * 2 <= wide:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if wide > reach:
            low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
        at = (low & LOW24).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        found.append((first + lo, np.diff(first, append=len(at)), h[at[first]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def depths(length: int) -> list[int]:
    """From the eight bytes of a machine word by doubling to the length, which is eight or more."""
    out = [8]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


class Transform:
    """The Burrows-Wheeler transform of one shard of strings, with what a merge needs of its suffixes.

    Suffixes are in the order of their first ``length`` bytes, equal ones by
    place. ``rows`` has their places in that order and ``last`` the byte in front
    of each: the transform. For each of the depths, ``classes`` numbers the
    places by their first bytes in order, and ``places`` has a place of each class.
    """

    def __init__(self, data: bytes, length: int):
        padded = np.frombuffer(data + bytes(length + 8), np.uint8)
        n = len(data)
        key = np.zeros(n + length, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | padded[i : i + n + length]
        self.size, self.head, self.classes, self.places = n, key, [], []
        deep = 0
        for depth in depths(length):
            if deep:
                low = self.classes[-1].astype(np.int64)
                jump = depth - deep
                key = low[: len(low) - jump] << 32 | low[jump:]
            _, place, of = np.unique(key, return_index=True, return_inverse=True)
            self.places.append(place.astype(np.int32))
            self.classes.append(of.astype(np.int32))
            deep = depth
        self.rows = np.argsort(self.classes[-1][:n], kind="stable").astype(np.int32)
        self.data = padded[:n]

    @property
    def last(self) -> np.ndarray:
        return self.data[self.rows - 1] if self.size else self.data


def interleave(shards: list[Transform], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(source, common) of the merged transform: for each row the shard it comes from, and the depth to which it agrees with the row before (0 for the first).

    The interleave starts from the first bytes and is refined from depth to
    depth: each shard's classes come sorted, their keys in the merged numbering
    keep that order, and merging the sorted runs gives the numbering at the next
    depth. Rows of one class share a prefix of that depth, adjacent classes
    share less, so each refinement leaves the common prefix of the rows it
    parts. No suffix is sorted again: only class lists, already in order, are
    merged, and the rows of a shard keep their order.
    """
    levels = depths(length)
    joint: list[np.ndarray] = []
    parted = []
    deep = 0
    for level, depth in enumerate(levels):
        keys = []
        for k, s in enumerate(shards):
            at = s.places[level]
            keys.append(s.head[at] if not deep else joint[k][s.classes[level - 1][at]] << 32 | joint[k][s.classes[level - 1][at + depth - deep]])
        run = np.concatenate(keys)
        order = np.argsort(run, kind="stable")  # merges the sorted runs
        number = np.empty(len(run), np.int64)
        ordered = run[order]
        number[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0) if len(run) else 0
        if deep:
            # of each class, the class of one level less that it lies in
            up = np.empty(int(number.max(initial=-1)) + 1, np.int64)
            up[number] = run >> 32
            parted.append(up)
        joint = np.split(number, np.cumsum([len(k) for k in keys])[:-1])
        deep = depth
    rows = np.concatenate([j[s.classes[-1][s.rows]] for j, s in zip(joint, shards)])
    order = np.argsort(rows, kind="stable")  # merges the shards' rows, which are in order
    source = np.repeat(np.arange(len(shards)), [s.size for s in shards])[order]
    now = rows[order]
    common = np.zeros(len(now), np.int64)
    before = np.arange(1, len(now))
    for depth, up in zip(reversed(levels), [*reversed(parted), None]):
        same = now[before] == now[before - 1]
        common[before[same]] = depth
        before = before[~same]
        if up is not None:
            now = up[now]
    return source, common


def merged(shards: list[Transform], source: np.ndarray) -> np.ndarray:
    """The transform of all shards: each row's byte from its shard, in the shard's order."""
    out = np.empty(len(source), np.uint8)
    for k, s in enumerate(shards):
        out[source == k] = s.last
    return out


def repeated_windows(strings: list[bytes], length: int, shard_bytes: int = 1 << 19) -> list[np.ndarray]:
    """For each string, whether each of its windows of ``length`` bytes also starts elsewhere in the strings.

    A row of the merged transform stands for a window if ``length`` bytes of its
    string follow. Maximal intervals of rows that agree to ``length`` bytes hold
    equal windows; those with more than one window are the repeated ones.
    """
    shards, group, size = [], [], 0
    for i, s in enumerate(strings):
        group.append(i)
        size += len(s)
        if size >= shard_bytes or i == len(strings) - 1:
            shards.append(group)
            group, size = [], 0
    if not shards:
        return []
    transforms = [Transform(b"".join(strings[i] for i in g), length) for g in shards]
    source, common = interleave(transforms, length)
    # windows within their string, in the order of each shard's rows
    own = []
    for g, t in zip(shards, transforms):
        left = np.concatenate([np.arange(len(strings[i]), 0, -1) for i in g])
        own.append(left >= length)
    inside = np.empty(len(source), bool)
    for k, t in enumerate(transforms):
        inside[source == k] = own[k][t.rows]
    interval = np.cumsum(common < length) - 1
    many = (np.bincount(interval, weights=inside, minlength=1) > 1)[interval] & inside
    out = []
    for k, (g, t) in enumerate(zip(shards, transforms)):
        flags = np.zeros(t.size, bool)
        flags[t.rows] = many[source == k]
        begin = 0
        for i in g:
            out.append(flags[begin : begin + max(0, len(strings[i]) - length + 1)])
            begin += len(strings[i])
    return out


def runs_of(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of set flags, one after the other."""
    return np.flatnonzero(np.diff(flags, prepend=False, append=False)).tolist()


def find_places(docs: DataFrame, length: int) -> DataFrame:
    """(row, first, windows, gram, content) for each run of windows under an anchor; content is a hash of all bytes of the run."""

    def run(batches):
        for batch in batches:
            rows, firsts, counts, grams, contents = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                first, n, gram = anchors(np.frombuffer(raw, np.uint8), length)
                rows.append(np.full(len(first), row, np.int64))
                firsts.append(first)
                counts.append(n)
                grams.append(gram.view(np.int64))
                contents += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (first + n + length - 1).tolist())]
            cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (rows, firsts, counts, grams)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3]), pa.array(np.array(contents, np.uint64).view(np.int64))], names=["row", "first", "windows", "gram", "content"])

    return docs.mapInArrow(run, "row long, first int, windows int, gram long, content long")


def _contents(rows: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """(gram, content, body) of one place of each content, cut out of the texts."""
    wanted = mixed.groupBy("gram", "content").agg(F.min(F.struct("row", "first", "windows")).alias("m")).select("m.row", F.struct("gram", "content", "m.first", "m.windows").alias("want"))
    wanted = wanted.groupBy("row").agg(F.collect_list("want").alias("want"))

    def run(batches):
        for batch in batches:
            out = []
            for text, want in zip(batch.column("text").to_pylist(), batch.column("want").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(w["gram"], w["content"], raw[w["first"] : w["first"] + w["windows"] + length - 1]) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], names=["gram", "content", "body"])

    # rows that are copies of each other give the same contents again
    return rows.join(wanted, "row").mapInArrow(run, "gram long, content long, body binary").dropDuplicates(["gram", "content"])


def _merge_groups(contents: DataFrame, length: int) -> DataFrame:
    """(gram, content, runs) by suffix merging, for groups that fit a task."""

    def solve(held):
        flags = repeated_windows([h[2] for h in held], length)
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([runs_of(f) for f in flags], pa.list_(pa.int32()))], names=["gram", "content", "runs"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for gram, content, body in zip(*(batch.column(c).to_pylist() for c in ("gram", "content", "body"))):
                if size > 1 << 21 and gram != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append((gram, content, body))
                size += len(body)
        if held:
            yield solve(held)

    return contents.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "gram long, content long, runs array<int>")


def _count_windows(contents: DataFrame, length: int) -> DataFrame:
    """(gram, content, runs) for groups of any size: 128-bit hashes of windows are counted, summed in the tasks first."""

    def split(batches):
        for batch in batches:
            for gram, content, body in zip(*(batch.column(c).to_pylist() for c in ("gram", "content", "body"))):
                n = len(body) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([gram] * n, pa.int64()), pa.array([content] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([xxhash.xxh3_128_digest(body[i : i + length]) for i in range(n)], pa.binary())], names=["gram", "content", "at", "window"])

    windows = cut(contents.mapInArrow(split, "gram long, content long, at int, window binary"), "windows")
    twice = cut(windows.groupBy("window").count().where("count > 1").select("window"), "repeated-windows")
    found = windows.join(twice, "window").select("gram", "content", "at").groupBy("gram", "content").agg(F.sort_array(F.collect_list("at")).alias("at"))
    step = lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1) == x), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x + 1))).otherwise(F.concat(a, F.array(x, x + 1)))
    return found.select("gram", "content", F.aggregate("at", F.array().cast("array<int>"), step).alias("runs"))


def repeated_spans(rows: DataFrame, length: int = 200, group: int = 4000) -> DataFrame:
    """(row, spans) of a stored table (row long, text), row unique: for each text the begins and ends of its bytes covered by a string of ``length`` bytes that starts anywhere else.

    Windows are dealt out by content: by the key of their anchor. Keys met once
    are done, and so are keys under which all places have the same bytes around
    them: both are found by counts of two hashes, without the text. Only where
    the bytes differ are they cut out, one place for each content; their
    transforms are built by shard and merged within the key's task; keys with
    more than ``group`` contents are counted window by window, spread over all
    tasks. A content is known by its key and its own hash, 128 bits together.
    """
    small_batches(rows.sparkSession)
    places = cut(find_places(rows, length), "places")
    keys = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1")
    keys = cut(keys.select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "keys")
    met = cut(places.join(keys, "gram"), "met")
    same = met.where("not mixed").select("row", F.col("first").alias("s"), (F.col("first") + F.col("windows") + length - 1).alias("e"))
    mixed = met.where("mixed")
    contents = cut(_contents(rows, mixed, length), "contents")
    hot = cut(contents.groupBy("gram").count().where(F.col("count") > group).select("gram"), "hot")
    found = _merge_groups(contents.join(hot, "gram", "left_anti"), length).unionByName(_count_windows(contents.join(hot, "gram", "left_semi"), length))
    own = mixed.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("n"), F.max("windows").alias("all"))
    found = cut(
        own.join(found, ["gram", "content"], "left")
        .select("gram", "content", F.when(F.col("n") > 1, F.array(F.lit(0), F.col("all"))).otherwise(F.coalesce("runs", F.array().cast("array<int>"))).alias("runs"))
        .where(F.size("runs") > 0),
        "found",
    )
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct(F.get("runs", i).alias("s"), F.get("runs", i + 1).alias("e")))
    differ = mixed.join(found, ["gram", "content"]).select("row", "first", F.explode(pairs).alias("p")).select("row", (F.col("first") + F.col("p.s")).alias("s"), (F.col("first") + F.col("p.e") + length - 1).alias("e"))
    spans = same.unionByName(differ).distinct()
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def suffix_dedup(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary) at the end: every byte covered by a string of ``length`` bytes that also starts elsewhere is taken out.

    Texts are UTF-8 bytes; a null or short text keeps all it has. Strings are
    judged on the input, in all documents and within one; matches never cross
    documents; overlaps count. Rows are told apart by a number of their own,
    given once and written, so repeated and null ids are no matter: repeated rows
    are copies of each other. Columns of the new names in the input are replaced.
    An empty table gives an empty table.
    """
    stored = cut(docs.withColumn("row__", F.monotonically_increasing_id()), "numbered")
    spans = cut(repeated_spans(stored.select(F.col("row__").alias("row"), F.col(text_col).alias("text")), length), "spans")
    new = ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())
    out = with_fields(docs.schema, *new)
    names = [f.name for f in out.fields]
    joined = without(stored, *(n for n, _ in new)).join(spans.withColumnsRenamed({"row": "row__", "spans": "spans__"}), "row__", "left")

    def run(batches):
        for batch in batches:
            got = {n: [] for n, _ in new}
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column("spans__").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                kept, at, gone, n = [], 0, 0, 0
                for s in spans or ():
                    if s["e"] > at:
                        if s["s"] > at or not n:
                            n += 1
                        begin = max(at, s["s"])
                        kept.append(raw[at:begin])
                        gone += s["e"] - begin
                        at = s["e"]
                kept.append(raw[at:])
                for name, value in zip(got, (len(raw), gone, n, b"".join(kept))):
                    got[name].append(value)
            cols = {n: pa.array(got[n], pa.binary() if n == "kept" else pa.int64()) for n in got}
            yield pa.RecordBatch.from_arrays([cols[n] if n in cols else batch.column(n) for n in names], names=names)

    return joined.mapInArrow(run, out)

