"""Hard negatives by exact inner products, scored with tables of subset sums (the method of the Four Russians)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm._common import cut, small_batches
from isohyet.llm.itq_dedup import usual_size

ANCHORS, SLICE = 1024, 4096  # rows of a block of anchors and of a slice of candidates, on the average
NO_ID = (1 << 63) - 1  # stands for the null id: after all others
STEP = 128  # anchors whose tables stay in cache together


def bit_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes: bit plane by bit plane of the two's complement, eight dimensions in a byte."""
    out = [np.packbits(((q >> b) & 1).astype(np.uint8), axis=1) for b in range(planes)]
    return np.stack(out, axis=1) if len(q) else np.empty((0, planes, -(-q.shape[1] // 8)), np.uint8)


def from_planes(packed: np.ndarray) -> np.ndarray:
    """The whole numbers that bit_planes packed, with zeros up to whole bytes."""
    planes = packed.shape[1]
    bits = np.unpackbits(packed, axis=2).astype(np.int64)
    return sum(bits[:, b] << b for b in range(planes - 1)) - (bits[:, planes - 1] << (planes - 1))


def subset_sums(anchors: np.ndarray, dtype=np.int64) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sum of the anchor's entries over every subset, named by its byte."""
    n, d = anchors.shape
    out = np.zeros((d // 8, 256, n), dtype)
    for g in range(d // 8):
        for j in range(8):
            out[g, 1 << j : 2 << j] = out[g, : 1 << j] + anchors[:, 8 * g + 7 - j].astype(dtype)
    return out


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(candidates, anchors): inner products, from the top plane down: look up each group's byte, add, double."""
    groups, _, n = tables.shape
    rows, planes = len(packed), packed.shape[1]
    at = np.ascontiguousarray(packed.transpose(1, 2, 0)).astype(np.intp)
    acc, part = np.zeros((rows, n), tables.dtype), np.empty((rows, n), tables.dtype)
    for b in range(planes - 1, -1, -1):
        if b < planes - 1:
            acc <<= 1
        for g in range(groups):
            np.take(tables[g], at[b, g], axis=0, out=part, mode="clip")
            if b == planes - 1:
                acc -= part
            else:
                acc += part
    return acc


def _best(keys: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each key: higher scores first, then those that come first in order."""
    at = np.lexsort((order, -score, keys))
    first = np.flatnonzero(np.diff(keys[at], prepend=keys[at[:1]] - 1) != 0) if len(at) else at
    run = np.repeat(first, np.diff(np.append(first, len(at)))) if len(at) else at
    return at[np.arange(len(at)) - run < k]


class _Kept:
    """The best k candidates of each key so far. Rows come in the order in which ties are settled."""

    def __init__(self, keys: int, k: int, low: np.ndarray) -> None:
        self.k, self.floor, self.low = k, low.astype(np.int64).copy(), low
        self.key, self.score, self.turn, self.row = (np.empty(0, np.int64) for _ in range(4))
        self.count = np.zeros(keys, np.int64)

    def offer(self, key: np.ndarray, score: np.ndarray, turn: np.ndarray, row: np.ndarray) -> None:
        key, score, turn, row = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.turn, turn), (self.row, row)))
        at = _best(key, score, turn, self.k)
        self.key, self.score, self.turn, self.row = key[at], score[at], turn[at], row[at]
        full = np.bincount(self.key, minlength=len(self.floor)) >= self.k
        worst = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.key, self.score)
        # later rows lose ties
        self.floor = np.where(full, worst + 1, self.low)


def _search(rows: DataFrame, counts: tuple[int, int], d: int, planes: int, kind: str, k: int, low: int, high: int, name: str) -> DataFrame:
    """Best candidates of every anchor, slice by slice, then overall.

    rows: (row, id, label, packed, anchor boolean[, targets array<struct<id, score>>]).
    kind "same": the k best other rows of the anchor's label. kind "other": for
    each target of score t, the k best rows of another label with a score from
    ceil(t * low) to floor(t * high), low and high being whole percentages.
    """
    groups = -(-d // 8)
    blocks, slices = max(1, math.ceil(counts[0] / ANCHORS)), max(1, math.ceil(counts[1] / SLICE))
    hashed = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    targets = F.col("targets") if "targets" in rows.columns else F.array().cast("array<struct<id:long,score:long>>")
    base = rows.withColumn("targets", targets)
    anchors = base.where("anchor").select(hashed(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "row", "id", "label", "packed", F.col("targets.id").alias("t_id"), F.col("targets.score").alias("t_score"))
    none = F.array().cast("array<long>")
    others = base.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), hashed(slices, 2).alias("slice"), F.lit(1).alias("kind"), "row", "id", "label", "packed", none.alias("t_id"), none.alias("t_score"))
    if kind == "other":
        anchors = anchors.where(F.size("t_id") > 0)
    dtype = np.int32 if planes * 2 + math.ceil(math.log2(max(2, 8 * groups))) < 31 else np.int64
    fields = "anchor_row long, anchor_id long, place int, target_id long, target_score long, id long, row long, score long"

    class Block:
        """One block of anchors, and what is best for them so far."""

        def __init__(self, held: list) -> None:
            self.row, self.id = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
            self.known: dict = {}
            self.label = self.codes([h[2] for h in held])
            order = np.argsort(self.label, kind="stable")
            self.row, self.id, self.label = self.row[order], self.id[order], self.label[order]
            held = [held[i] for i in order]
            self.entries = from_planes(np.array([np.frombuffer(h[3], np.uint8) for h in held]).reshape(-1, planes, groups))
            self.t_id, self.t_score = [h[4] for h in held], [h[5] for h in held]
            self.parts = [np.arange(lo, min(lo + STEP, len(held))) for lo in range(0, len(held), STEP)]
            self.tables: list = [None] * len(self.parts)
            n = len(held)
            if kind == "same":
                self.width, lows = 1, np.full(n, np.iinfo(np.int64).min // 2)
                self.high = np.full((n, 1), np.iinfo(np.int64).max)
            else:
                self.width = max((len(t) for t in self.t_score), default=1)
                t = np.full((n, self.width), -1, np.int64)  # a target below 0 has no candidates, as its range is empty
                for i, s in enumerate(self.t_score):
                    t[i, : len(s)] = s
                whole_low, self.high = -((-t * low) // 100), (t * high) // 100
                self.high = np.where(t < 0, np.iinfo(np.int64).min, self.high)
                lows = np.where(t < 0, np.iinfo(np.int64).max, whole_low).ravel()
            self.kept = _Kept(n * self.width, k, lows)
            self.ids: list = []
            self.seen = 0

        def codes(self, labels: list) -> np.ndarray:
            return np.array([self.known.setdefault(x, len(self.known)) for x in labels], np.int64)

        def meet(self, row: np.ndarray, ids: np.ndarray, labels: list, packed: np.ndarray) -> None:
            label = self.codes(labels)
            turn = self.seen + np.arange(len(row))
            self.seen += len(row)
            self.ids.append(np.stack([row, ids]))
            for p, part in enumerate(self.parts):
                if kind == "same":
                    live = np.flatnonzero(np.isin(label, self.label[part]))
                    if not len(live):
                        continue
                else:
                    live = np.arange(len(row))
                if self.tables[p] is None:
                    self.tables[p] = subset_sums(self.entries[part], dtype)
                for lo in range(0, len(live), 512):
                    at = live[lo : lo + 512]
                    got = scores(self.tables[p], packed[at])
                    w = self.width
                    floor = self.kept.floor.reshape(-1, w)[part]
                    fits = (got >= floor.min(axis=1)) & (got <= self.high[part].max(axis=1))
                    fits &= (label[at][:, None] == self.label[part][None, :]) == (kind == "same")
                    if kind == "same":
                        fits &= row[at][:, None] != self.row[part][None, :]
                    c, a = np.nonzero(fits)
                    if not len(c):
                        continue
                    score = got[c, a].astype(np.int64)
                    for j in range(w):
                        key = part[a] * w + j
                        ok = (score >= self.kept.floor[key]) & (score <= self.high[part[a], j])
                        if ok.any():
                            self.kept.offer(key[ok], score[ok], turn[at][c[ok]], turn[at][c[ok]])

        def result(self) -> pa.RecordBatch:
            kept, w = self.kept, self.width
            a, j = kept.key // w, kept.key % w
            row, ids = np.concatenate(self.ids, axis=1) if self.ids else np.empty((2, 0), np.int64)
            pick = lambda lists: pa.array([lists[x][y] if y < len(lists[x]) else None for x, y in zip(a, j)], pa.int64())
            cols = [pa.array(self.row[a]), pa.array(self.id[a]), pa.array(j.astype(np.int32)), pick(self.t_id), pick(self.t_score), pa.array(ids[kept.row]), pa.array(row[kept.row]), pa.array(kept.score)]
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in fields.split(", ")])

    def run(batches):
        at, held, block = None, [], None
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "slice", "kind", "row", "id")}
            change = np.flatnonzero(np.any([np.diff(cols[c], prepend=cols[c][:1] - 1) != 0 for c in ("block", "slice", "kind")], axis=0))
            for i, j in zip(change, [*change[1:], batch.num_rows]):
                key = (cols["block"][i], cols["slice"][i])
                if key != at:
                    if block is not None:
                        yield block.result()
                    at, held, block = key, [], None
                piece = batch.slice(i, j - i)
                labels = piece.column("label").to_pylist()
                if cols["kind"][i] == 0:
                    held += zip(cols["row"][i:j].tolist(), cols["id"][i:j].tolist(), labels, piece.column("packed").to_pylist(), piece.column("t_id").to_pylist(), piece.column("t_score").to_pylist())
                    continue
                if block is None:
                    if not held:
                        continue  # no anchors here
                    block, held = Block(held), []
                packed = np.frombuffer(b"".join(piece.column("packed").to_pylist()), np.uint8).reshape(-1, planes, groups)
                block.meet(cols["row"][i:j], cols["id"][i:j], labels, packed)
        if block is not None:
            yield block.result()

    keys = ["block", "slice"]
    found = anchors.unionByName(others).repartition(*keys).sortWithinPartitions(*keys, "kind", "id", "row").mapInArrow(run, fields)
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "id", "row")
    return cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), by exact scores of all rows.

    Entries become whole numbers floor(scale * x); a score is their inner
    product. Every row for which ``anchor`` holds gets its ``positives`` best other
    rows of its label, and each of those the ``negatives`` best rows of another
    label that score between ``low`` and ``high`` percent of it; equal scores go by
    the smaller id.

    Blocks of anchors meet slices of all rows as keys of a shuffle: both sides'
    blocks are of a fixed mean size, so a label or a vector that many rows share
    weighs on no task. In a task each anchor has a table of subset sums for every
    eight dimensions; a candidate is its bit planes, bytes that index the tables,
    and the score is looked up and shifted plane by plane. Only the best of each
    slice leave it.

    Rows with a null label, a null or empty vector, null or non-finite entries,
    or not of the usual size take no part. Entries are held within the largest
    numbers whose scores a long holds (2^20 for 64 dimensions). Each row is a
    row of its own, repeated ids too; a null id comes last among equals and is
    null in the result. Anchors without positives, positives without negatives
    and empty tables give no rows; other columns are not read.
    """
    small_batches(vectors.sparkSession)
    own = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = own.where("label is not null")
    d = usual_size(own, "vec")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = own.where(F.coalesce((F.size("vec") == d) & finite, F.lit(False)))
    most = 1 << ((62 - math.ceil(math.log2(max(2, d)))) // 2)
    whole = F.transform("vec", lambda x: F.floor(F.greatest(F.lit(-float(most)), F.least(F.lit(most - 1.0), x * scale))).cast("long"))
    good = cut(good.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", whole.alias("q")), "integers")
    n, n_anchors, far = good.agg(F.count(F.lit(1)), F.sum(F.col("anchor").cast("long")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()
    planes = max(2, int(far or 0).bit_length() + 1)

    def pack(batches):
        for batch in batches:
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            packed = pa.array([p.tobytes() for p in bit_planes(q, planes)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label", "anchor")), packed], names=["row", "id", "label", "anchor", "packed"])

    rows = cut(good.mapInArrow(pack, "row long, id long, label string, anchor boolean, packed binary"), "bit-planes")
    near = _search(rows, (n_anchors or 0, n), d, planes, "same", positives, 0, 0, "positives")
    listed = near.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("t"))
    listed = listed.select(F.col("anchor_row").alias("row"), F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["score"].alias("score"))).alias("targets"))
    far_rows = rows.join(listed, "row", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<struct<id:long,score:long>>")))
    found = _search(far_rows, (n_anchors or 0, n), d, planes, "other", negatives, low, high, "negatives")
    named = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return found.select(named("anchor_id").alias("anchor_id"), named("target_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), named("id").alias("negative_id"), F.col("target_score").alias("positive_score"), F.col("score").alias("negative_score"))
