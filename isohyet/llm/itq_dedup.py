"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm._common import cut, small_batches, spread
from isohyet.llm.components import connected_components
from isohyet.llm.simhash import settle

FEW = 64  # vectors, from which medians and rotations mean something
SIGNATURE = 128  # bits of the code that stands for a vector in the tables


def learn_rotation(sample: np.ndarray, rng: np.random.Generator, turns: int = 30) -> np.ndarray:
    """A rotation of centred data under which signs lose least (Gong and Lazebnik's iteration)."""
    rotation = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))[0]
    for _ in range(turns):
        u, _, vt = np.linalg.svd(np.where(sample @ rotation >= 0, 1.0, -1.0).T @ sample)
        rotation = (u @ vt).T
    return rotation


def learn_codes(sample: np.ndarray, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, projection, thresholds) of ``bits`` balanced bits: principal axes, one learnt rotation after another, medians as thresholds."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    if not len(sample):
        return np.zeros(d), rng.standard_normal((d, bits)), np.zeros(bits)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    parts, have = [], 0
    while have < bits:
        rotation = axes @ learn_rotation(centred @ axes, rng)
        parts.append(rotation)
        have += d
    projection = np.concatenate(parts, axis=1)[:, :bits]
    middle = [np.median(centred @ projection[:, lo : lo + d], axis=0) for lo in range(0, bits, d)]
    return mean, projection, np.concatenate(middle)


def table_plan(n: int, least: float, recall: float = 0.97) -> tuple[int, int]:
    """(bits of a key, tables): keys grow with the logarithm of the input, so that a bucket keeps its size; tables are as many as find a pair at the least cosine with the given chance."""
    width = min(30, max(8, math.ceil(math.log2(max(2, n) / 16))))
    meet = (1 - math.acos(least) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def near_pairs(unit: np.ndarray, least: float, rng: np.random.Generator, anchors: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, group): pairs of unit vectors at a cosine of ``least`` like those the data may hold, and the group in which recall is measured.

    Each anchor is moved to the cosine in a direction without preference and in
    one between two vectors of the sample; pairs of the sample at or little above
    the cosine are taken as they are. Anchors are grouped by how many vectors of
    the sample are near them, so that a dense group has a figure of its own.
    """
    n, d = unit.shape
    at = rng.choice(n, min(n, anchors), replace=False)
    x = unit[at]
    crowd, i, j = np.zeros(len(at), np.int64), [], []
    for lo in range(0, len(at), 128):
        cosines = x[lo : lo + 128] @ unit.T
        crowd[lo : lo + 128] = (cosines >= 0.8 * least).sum(axis=1)
        a, b = np.nonzero((cosines >= least) & (cosines < least + 0.2 * (1 - least)))
        i.append(a + lo)
        j.append(b)
    i, j = np.concatenate(i), np.concatenate(j)
    dense = np.argsort(np.argsort(crowd, kind="stable")) * 5 // len(at)
    parts = []
    for kind, step in enumerate((rng.standard_normal(x.shape), unit[rng.integers(0, n, len(at))] - unit[rng.integers(0, n, len(at))])):
        step -= (step * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(step, axis=1)
        ok = size > 1e-9
        parts.append((x[ok], least * x[ok] + math.sqrt(1 - least * least) * step[ok] / size[ok, None], 5 * kind + dense[ok]))
    if len(i) >= 100:
        some = rng.choice(len(i), min(len(i), 5 * anchors), replace=False)
        parts.append((x[i[some]], unit[j[some]], 10 + dense[i[some]]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def bits_of(unit: np.ndarray, codes: tuple, rows: int = 1024) -> np.ndarray:
    """Bits of unit vectors, a thousand at a time: the projections are doubles, the bits are not."""
    mean, projection, threshold = codes
    out = np.empty((len(unit), len(threshold)), bool)
    for lo in range(0, len(unit), rows):
        np.greater_equal((unit[lo : lo + rows] - mean) @ projection, threshold, out=out[lo : lo + rows])
    return out


def measured_plan(n: int, sample: np.ndarray, least: float, recall: float = 0.97, most: int = 128):
    """(bits of a key, tables, codes): tables are as many as find, by the learnt bits, the wanted share of near pairs in the worst group.

    Where ``most`` tables are not enough, keys get shorter: buckets grow, and
    none is cut short, so that recall is kept at the price of comparisons. From a
    handful of vectors nothing can be learnt: they share the one bucket of one table.
    """
    width, tables = table_plan(n, least, recall)
    if len(sample) < FEW:
        return 1, 1, (np.zeros(sample.shape[1]), np.zeros((sample.shape[1], 1)), np.ones(1))
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    a, b, group = near_pairs(unit, least, np.random.default_rng(3))
    mean, projection, threshold = codes = learn_codes(sample, width * most)
    same = bits_of(a, codes) == bits_of(b, codes)
    groups = [group == g for g in np.unique(group) if (group == g).sum() >= 20] or [np.ones(len(group), bool)]
    while True:
        usable = min(most, same.shape[1] // width)
        met = np.logical_or.accumulate(same[:, : usable * width].reshape(len(same), usable, width).all(axis=2), axis=1)
        worst = np.min([met[g].mean(axis=0) for g in groups], axis=0)
        enough = np.flatnonzero(worst >= recall)
        if len(enough) or width == 1:
            tables = max(tables, int(enough[0]) + 1) if len(enough) else usable
            tables = min(tables, usable)
            return width, tables, (mean, projection[:, : width * tables], threshold[: width * tables])
        width -= 1




def code_bound(sample: np.ndarray, signature: tuple, least: float) -> int:
    """Most bits of the signature in which near pairs differ: two more than any pair of near_pairs does."""
    if len(sample) < FEW:
        return SIGNATURE
    a, b, _ = near_pairs(sample / np.linalg.norm(sample, axis=1, keepdims=True), least, np.random.default_rng(3))
    apart = bits_of(a, signature) != bits_of(b, signature)
    return int(apart.sum(axis=1).max(initial=SIGNATURE - 2 if not len(a) else 0)) + 2


def valid(col: str, size: int) -> F.Column:
    """Whether a vector can be compared: of the size that is usual here, finite throughout, and not zero."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(col) == size) & finite & F.exists(col, lambda x: x != 0), F.lit(False))


def usual_size(vectors: DataFrame, col: str) -> int:
    sizes = vectors.where(F.col(col).isNotNull()).groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return max(1, sizes.d) if sizes else 1


def bucket_runs(cols: list[np.ndarray], keys: int):
    """(begin, end) of the runs of equal keys, the first ``keys`` columns, of two rows or more."""
    change = np.flatnonzero(np.any([np.diff(c, prepend=c[0] - 1) != 0 for c in cols[:keys]], axis=0))
    return [(i, j) for i, j in zip(change, [*change[1:], len(cols[0])]) if j - i > 1]


def by_bucket(batches, columns, solve, keys: int = 4, rows: int = 8192):
    """solve(columns) over sorted batches, never cutting a bucket in two."""
    held, n = [], 0
    for batch in batches:
        held.append(columns(batch))
        n += batch.num_rows
        if n >= rows:
            cols = [np.concatenate(c) for c in zip(*held)]
            last = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
            at = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if at:
                yield solve([c[:at] for c in cols])
            held, n = [[c[at:] for c in cols]], len(cols[0]) - at
    if n:
        yield solve([np.concatenate(c) for c in zip(*held)])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, sample: int = 20_000, block: int = 1024) -> DataFrame:
    """(id, n_links, component) for each row: vectors of a cosine of at least ``least`` link.

    A rotation is learnt on at most ``sample`` distinct vectors; all vectors are
    coded and put into every table under that table's part of the code. A row of a
    table is a key, a node and the first 128 bits of its code. Nodes that share a
    key with one whose bits are near (code_bound) are candidates there; only for
    them, vectors and keys are fetched, and compared in double precision with the
    original components, so no link is below ``least``. The number of tables is set
    by measuring the learnt bits on the sample, for a share of 0.97 of the pairs
    just at it, in the worst group (see measured_plan). A pair is counted in the
    first table where its keys agree, so counts add up without pairs leaving the
    task. Buckets of more than ``block`` vectors are split into pairs of blocks,
    each a shuffle key of its own; none is cut short.

    Equal vectors are one node with a count. Every row is a vector of its own:
    rows of one id, or without one, are linked by their vectors alone. Vectors
    that are null, zero, hold null or non-finite components, or are not of the
    usual size link with nothing. Components take the smallest id; null ids name
    nothing: where there is no other in a class, its component is null. Repeated
    rows are vectors like any other. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    d = usual_size(own, "vec")
    nodes = own.where(valid("vec", d)).groupBy("vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    learnt = nodes.orderBy(F.xxhash64("vec")).limit(sample).select("vec").toArrow().column(0)
    at = np.array(learnt.to_pylist(), np.float64).reshape(-1, d)
    width, tables, codes = measured_plan(nodes.count(), at, least)
    signature = learn_codes(at, SIGNATURE)
    bound = code_bound(at, signature, least)
    coder = spark.sparkContext.broadcast((codes, signature))

    def code(batches):
        (mean, projection, threshold), (_, first, middle) = coder.value
        powers = (1 << np.arange(width)).astype(np.int64)
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True) - mean
            bits = (unit @ projection >= threshold).reshape(len(x), tables, width)
            keys = (bits * powers).sum(axis=2).astype(np.int32)
            short = np.packbits(unit @ first >= middle, axis=1).reshape(-1).view(np.int64).reshape(len(x), -1)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(short[:, 0].copy()), pa.array(short[:, 1].copy()), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["node", "c0", "c1", "keys"])

    coded = cut(nodes.select("node", "vec").mapInArrow(code, "node long, c0 long, c1 long, keys array<int>"), "codes")
    placed = coded.select("node", "c0", "c1", F.posexplode("keys").alias("tab", "key"))
    large = coded.select(F.posexplode("keys").alias("tab", "key")).groupBy("tab", "key").count().where(F.col("count") > block)
    large = cut(large.select("tab", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-buckets")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiled = (
        placed.join(large, ["tab", "key"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("tab", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "c0", "c1")
    )
    names = ["tab", "key", "lo", "hi"]

    def candidates(batches):
        """Rows of the tables whose bits are near those of another row of their bucket."""

        def solve(cols):
            keep = np.zeros(len(cols[0]), bool)
            for i, j in bucket_runs(cols, 4):
                c0, c1, part = cols[6][i:j].view(np.uint64), cols[7][i:j].view(np.uint64), cols[4][i:j]
                met = np.zeros(j - i, bool)
                for at in range(0, j - i, 512):
                    near = np.bitwise_count(c0[at : at + 512, None] ^ c0).astype(np.int16) + np.bitwise_count(c1[at : at + 512, None] ^ c1) <= bound
                    near[np.arange(len(near)), at + np.arange(len(near))] = False
                    if cols[2][i] != cols[3][i]:
                        near &= part[at : at + 512, None] != part
                    met |= near.any(axis=0)
                keep[i:j] = met
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols[:6]], names=[*names, "mine", "node"])

        yield from by_bucket(batches, lambda b: [b.column(c).to_numpy(zero_copy_only=False) for c in [*names, "mine", "node", "c0", "c1"]], solve)

    met = cut(tiled.repartition(*names).sortWithinPartitions(*names).mapInArrow(candidates, "tab int, key int, lo int, hi int, mine int, node long"), "candidates")
    full = nodes.join(coded.select("node", "keys"), "node").select("node", "copies", "vec", "keys")
    asked = met.join(full, "node").select(*names, "mine", "node", "copies", "vec", "keys")

    def compare(tab, lo, hi, mine, node, copies, vec, keys):
        """Links of one pair of blocks: (node, linked vectors, first node of its class here)."""
        unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
        n = len(node)
        links, a_all, b_all = np.zeros(n, np.int64), [], []
        for at in range(0, n, 512):
            a, b = np.nonzero(unit[at : at + 512] @ unit.T >= least)
            a += at
            good = (a < b) & ((mine[a] != mine[b]) | (lo == hi))
            a, b = a[good], b[good]
            if tab:
                first = ~(keys[a, :tab] == keys[b, :tab]).any(axis=1) if len(a) < 1 << 20 else np.concatenate([~(keys[x, :tab] == keys[y, :tab]).any(axis=1) for x, y in zip(np.array_split(a, 64), np.array_split(b, 64))])
                np.add.at(links, a[first], copies[b[first]])
                np.add.at(links, b[first], copies[a[first]])
                a, b = a[first], b[first]
            else:
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
            a_all.append(a)
            b_all.append(b)
        hit = np.flatnonzero(links)
        label = settle(n, np.concatenate(a_all), np.concatenate(b_all), np.arange(n))
        return node[hit], links[hit], node[label[hit]]

    def run(batches):
        def columns(batch):
            flat = lambda c, t, w: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(t).reshape(-1, w)
            return [*(batch.column(c).to_numpy(zero_copy_only=False) for c in [*names, "mine", "node", "copies"]), flat("vec", np.float64, d), flat("keys", np.int32, tables)]

        def solve(cols):
            out = [compare(cols[0][i], cols[2][i], cols[3][i], *(c[i:j] for c in cols[4:])) for i, j in bucket_runs(cols, 4)]
            out = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "links", "up"])

        yield from by_bucket(batches, columns, solve)

    found = cut(asked.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "node long, links long, up long"), "links")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("up").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(counts, "node", "left").join(roots, "node", "left")
    named = cut(named.select("vec", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    classes = cut(named.join(spread(lowest), "root").select("vec", "n_links", "component"), "classes")
    good, bad = own.where(valid("vec", d)), own.where(~valid("vec", d))
    linked = good.join(classes, "vec").select("id", "n_links", "component")
    return linked.unionByName(bad.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
