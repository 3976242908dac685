"""SimHash near-dedup by a binary trie self-join."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm._common import cut, small_batches, spread
from isohyet.llm.components import connected_components

ONE = np.uint64(1)


def fingerprint(text: str | None, words: int = 4, seed: int = 42, lanes: int = 1) -> list[int]:
    """64-bit SimHashes of the word shingles, repeats included; 0 without words. The first lane takes XXH64 as it is, each other lane a mix of it."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return [0] * lanes
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    k = min(words, len(parts))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    hashed, n = xxhash.xxh64_intdigest, len(stops)
    ones = np.zeros((lanes, 64), np.int64)
    for lo in range(0, n, 1 << 16):
        h = np.array([hashed(line[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 16)], stops[lo : lo + (1 << 16)])], np.uint64)
        for lane in range(lanes):
            if lane:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            ones[lane] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(row * 2 > n).tobytes(), "big") for row in ones]


def shingles(text: str | None, words: int = 5, seed: int = 42) -> tuple[bytes, np.ndarray]:
    """(128-bit digest of the word sequence, sorted distinct 64-bit hashes of its word shingles); a shorter text is one shingle, no words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(parts)
    node = xxhash.xxh3_128_digest(line)
    if not parts:
        return node, np.empty(0, np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    return node, np.unique(np.fromiter((hashed(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops)))


@functools.lru_cache(maxsize=4)
def _factors(lanes: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, (64 * lanes, 1), np.uint64) * np.uint64(2) + ONE


def minwise(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """64-bit lanes of one-bit MinHashes of a set: two sets of Jaccard similarity J differ in each bit with a chance of (1 - J) / 2."""
    if not len(hashes):
        return np.zeros(lanes, np.uint64)
    factors = _factors(lanes)
    low = np.full(64 * lanes, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 128):
        np.minimum(low, (factors * hashes[lo : lo + 128]).min(axis=1), out=low)
    bits = ((low >> np.uint64(20)) & ONE).astype(np.uint8)
    return np.packbits(bits).view(">u8").astype(np.uint64)


def settle(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest label reachable over the links a-b, by hooking and pointer jumping."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while True:
            step = new[new]
            if np.array_equal(step, new):
                break
            new = step
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links among a-b that join all that a-b join beside the classes of ``label``, without cycles; the first links are taken first."""
    label, kept = np.arange(n) if label is None else label, [(a[:0], b[:0])]
    while True:
        live = label[a] != label[b]
        a, b = a[live], b[live]
        if not len(a):
            return tuple(np.concatenate(c) for c in zip(*kept))
        best = np.full(n, len(a))
        for end in (a, b):
            np.minimum.at(best, label[end], np.arange(len(a)))
        pick = np.unique(best[best < len(a)])
        kept.append((a[pick], b[pick]))
        label = settle(n, a[pick], b[pick], label)


def trie_links(code: np.ndarray, root: np.ndarray, shared: np.ndarray, budget: int, lanes: np.ndarray | None = None, total: int = 64, leaf: int = 256, links: str = "classes", known: np.ndarray | None = None, fits=None):
    """Pairs under one root whose codes differ in at most budget bits, and, where lanes are given, in at most total bits over all lanes.

    code is sorted within each root, and the shared[i] leading bits of code are
    equal for all i of a root. Node pairs go down the trie together, level by
    level; a pair's error count is the number of differing bits on its paths.
    Pairs beyond the budget go, as do pairs of nodes that hold one and the same
    class already; so the budget grows in steps, and dense groups of near copies
    are joined along close links before wide ones are looked at. ``known``
    numbers the classes that are there from the start.

    The result with links = "classes" is a label for each code, the smallest
    place linked to it; with "forest" (a, b), pairs that join each class without
    cycles, close ones first; with "pairs" every pair that isn't within a known
    class. ``fits`` (i, j) -> mask leaves out pairs that can't be links for another reason.
    """
    n = len(code)
    label = np.arange(n)
    if known is not None and n:
        _, first, turn = np.unique(known, return_index=True, return_inverse=True)
        label = first[turn]
    none = np.empty(0, np.int64)
    kept_a, kept_b = [none], [none]
    begin = np.flatnonzero(np.diff(root, prepend=root[0] - 1)) if n else none
    end = np.append(begin[1:], n)
    deep = shared[begin].astype(np.int64) if n else none
    for allowed in sorted({min(budget, 1), min(budget, 2), budget}) if links != "pairs" else [budget]:
        turns = np.cumsum(np.diff(label, prepend=label[:1]) != 0)
        found, n_found = [(none, none, none)], 0
        keep = end - begin > 1
        stack = [(begin[keep], end[keep], begin[keep], end[keep], deep[keep], np.zeros(keep.sum(), np.int64))] if n > 1 else []
        while stack:
            al, ah, bl, bh, depth, err = stack.pop()
            one = (turns[al] == turns[ah - 1]) & (turns[bl] == turns[bh - 1]) & (label[al] == label[bl])
            al, ah, bl, bh, depth, err = (x[~one] for x in (al, ah, bl, bh, depth, err))
            small = ((ah - al) * (bh - bl) <= leaf) | (depth >= 64)
            for s in np.array_split(np.flatnonzero(small), max(1, int(small.sum()) >> 11)):
                if len(s):
                    na, nb = ah[s] - al[s], bh[s] - bl[s]
                    size = na * nb
                    which = np.repeat(np.arange(len(s)), size)
                    off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    i, j = al[s][which] + off // nb[which], bl[s][which] + off % nb[which]
                    good = (i < j) & (label[i] != label[j])
                    i, j = i[good], j[good]
                    if fits is not None:
                        good = fits(i, j)
                        i, j = i[good], j[good]
                    bits = np.bitwise_count(code[i] ^ code[j]).astype(np.int64)
                    good = bits <= allowed
                    i, j, bits = i[good], j[good], bits[good]
                    if lanes is not None:
                        bits = np.bitwise_count(lanes[i] ^ lanes[j]).sum(axis=1, dtype=np.int64)
                        good = bits <= total
                        i, j, bits = i[good], j[good], bits[good]
                    found.append((i, j, bits))
                    n_found += len(i)
                    if links != "pairs" and n_found > 1 << 20:
                        found = [_close(n, found, label)]
                        n_found = len(found[0][0])
            al, ah, bl, bh, depth, err = (x[~small] for x in (al, ah, bl, bh, depth, err))
            if not len(al):
                continue
            if len(al) > 1 << 18:
                half = len(al) // 2
                stack += [tuple(x[s] for x in (al, ah, bl, bh, depth, err)) for s in (slice(half), slice(half, None))]
                continue
            am, bm = (_middle(code, lo, hi, depth) for lo, hi in ((al, ah), (bl, bh)))
            same = al == bl
            kids = [(al, am, bl, bm, err, None), (am, ah, bm, bh, err, None), (al, am, bm, bh, err + 1, None), (am, ah, bl, bm, err + 1, ~same)]
            out = []
            for w, x, y, z, e, only in kids:
                ok = (x > w) & (z > y) & (e <= allowed)
                ok &= True if only is None else only
                ok &= ~((w == y) & (x - w == 1))
                out.append([v[ok] for v in (w, x, y, z, depth + 1, e)])
            stack.append(tuple(np.concatenate(c) for c in zip(*out)))
        a, b, _ = (np.concatenate(c) for c in zip(*found)) if links == "pairs" else _close(n, found, label)
        kept_a.append(a)
        kept_b.append(b)
        if links != "pairs" and len(a):
            label = settle(n, a, b, label)
    return label if links == "classes" else (np.concatenate(kept_a), np.concatenate(kept_b))


def _close(n: int, found: list, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest of the links found, those of the fewest bits first."""
    a, b, bits = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(bits, kind="stable")
    a, b = forest(n, a[order], b[order], label)
    return a, b, np.zeros(len(a), np.int64)


def _middle(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First place of [lo, hi) whose bit at depth is 1."""
    shift = (63 - depth).astype(np.uint64)
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        bit = ((code[np.minimum(mid, len(code) - 1)] >> shift) & ONE).astype(bool)
        hi = np.where(open_ & bit, mid, hi)
        lo = np.where(open_ & ~bit, mid + 1, lo)


def _roots(budget: int, n: int, most: int = 1 << 16) -> list[list[tuple[int, int]]]:
    """Sets of blocks of bits, each block (first bit, width), such that codes within the budget agree on all blocks of one set at least.

    With budget + k blocks, k of them agree. k is the smallest for which a root
    of random codes holds at most ``most`` of n, so roots keep their size as the
    input grows.
    """
    k = 1
    while k < 6 and n >> (64 * k // (budget + k)) > most:
        k += 1
    blocks = budget + k
    ends = [64 * i // blocks for i in range(blocks + 1)]
    return [list(c) for c in itertools.combinations([(a, b - a) for a, b in zip(ends, ends[1:])], k)]


def _turned(code: F.Column, blocks: list[tuple[int, int]]) -> F.Column:
    """The code with its bits in another order: those of the blocks first, then the rest as they come. Equal bits stay equal, so distances do."""
    if len(blocks) == 1:
        at = blocks[0][0]
        return F.shiftleft(code, at).bitwiseOR(F.shiftrightunsigned(code, 64 - at)) if at else code
    rest, at = [], 0
    for first, width in [*blocks, (64, 0)]:
        rest += [(at, first - at)] * (first > at)
        at = first + width
    out, place = F.lit(0).cast("long"), 0
    for first, width in [*blocks, *rest]:
        part = F.shiftrightunsigned(F.shiftleft(code, first), 64 - width) if width < 64 else code
        out = out.bitwiseOR(F.shiftleft(part, 64 - place - width))
        place += width
    return out


def hamming_links(codes: DataFrame, n: int, lanes: int = 1, budget: int = 4, total: int | None = None, links: str = "classes", split: int = 1 << 18, similarity: float | None = None) -> DataFrame:
    """n codes (node long, lanes array<long>[, known long][, size int, shared int]) -> edges (a, b): see trie_links; for "classes", from each code to the first of its class.

    With ``similarity`` codes stand for sets of a size, of which so many members
    are shared with any other set: a pair is left out if it can't have that
    Jaccard similarity s, as sets that do have at least s / (1 + s) of both
    sizes in common, and that is at most what either shares.

    Two nodes link if one lane of theirs differs in at most budget bits and all
    lanes together in at most total. One trie per lane and set of blocks (see
    _roots): the code is turned so that the blocks come first, and node pairs
    that share them go on below. Two codes within the budget agree on a whole
    set, so they meet under one root; a root is a key of the shuffle, its codes
    come sorted. A root of more than ``split`` codes (near copies with many
    codes) is dealt out as pairs of its parts, each a key of its own.

    A row of a trie is a key, a node and the turned code; the other lanes are
    looked at afterwards, for the links of a forest alone. Only "pairs", which is
    asked for few nodes, takes them along, so that pairs beyond total never leave
    a task.
    """
    sets = _roots(budget, n)
    along = links == "pairs" and total is not None and lanes > 1
    if total is not None and lanes > 1 and links == "classes":
        raise ValueError("classes are not pairs: a limit over all lanes needs forest or pairs")
    rows, depths = [], []
    for lane in range(lanes):
        for blocks in sets:
            width = sum(w for _, w in blocks)
            turned = _turned(F.col("lanes")[lane], blocks)
            rows.append(turned)
            depths.append(width)
    extra = [c for c in ("known", "size", "shared") if c in codes.columns]
    wide = ["lanes"] * along
    rows = codes.select("node", *wide, *extra, F.posexplode(F.array(*rows)).alias("block", "turned"))
    width = F.element_at(F.array(*[F.lit(w) for w in depths]), F.col("block") + 1)
    rows = rows.withColumn("head", F.call_function("shiftrightunsigned", "turned", 64 - width))
    keys = ["block", "head"]
    if n > split:
        large = rows.groupBy(*keys).count().where(F.col("count") > split).select(*keys, F.ceil(2 * F.col("count") / split).cast("int").alias("parts"))
        mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        rows = (
            rows.join(cut(large, "large-roots"), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("node", *wide, *extra, *keys, "turned", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
        )
        keys += ["lo", "hi"]
    widths = np.array(depths)

    def solve(cols):
        order = np.lexsort((cols["turned"].view(np.uint64), *(cols[k] for k in reversed(keys))))
        cols = {k: v[order] for k, v in cols.items()}
        change = np.any([np.diff(cols[k], prepend=cols[k][0] - 1) != 0 for k in keys], axis=0)
        node = cols["node"]
        fits = None
        if similarity is not None:
            size, shared = cols["size"].astype(np.int64), cols["shared"].astype(np.int64)
            fits = lambda i, j: np.minimum(shared[i], shared[j]) * (1 + similarity) >= similarity * (size[i] + size[j]) - 1e-6
        got = trie_links(cols["turned"].view(np.uint64), np.cumsum(change), widths[cols["block"]], budget, cols.get("lanes"), total or 64, links=links, known=cols.get("known"), fits=fits)
        if links == "classes":
            far = np.flatnonzero(got != np.arange(len(got)))
            got = far, got[far]
        a, b = node[got[0]], node[got[1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ["node", *extra, *keys, "turned"]}
            if along:
                cols["lanes"] = batch.column("lanes").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
            held.append(cols)
            n += batch.num_rows
            if n >= 1 << 16:
                cols = {k: np.concatenate([h[k] for h in held]) for k in cols}
                last = np.flatnonzero(np.any([cols[k] != cols[k][-1] for k in keys], axis=0))
                at = last[-1] + 1 if len(last) else 0  # the last root may go on in the next batch
                if at:
                    yield solve({k: v[:at] for k, v in cols.items()})
                held, n = [{k: v[at:] for k, v in cols.items()}], n - at
        if n:
            yield solve({k: np.concatenate([h[k] for h in held]) for k in held[0]})

    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")
    if links != "forest" or total is None or lanes == 1:
        return found
    ends = [codes.select(F.col("node").alias(c), F.col("lanes").alias(f"lanes_{c}")) for c in "ab"]
    bits = sum(F.bit_count(F.col("lanes_a")[i].bitwiseXOR(F.col("lanes_b")[i])) for i in range(lanes))
    return found.distinct().join(ends[0], "a").join(ends[1], "b").where(bits <= total).select("a", "b")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """(id long, lanes array<long>) for each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words, lanes=lanes) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(fp.view(np.int64)))], names=["id", "lanes"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, lanes array<long>")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, budget: int = 4, lanes: int = 1) -> DataFrame:
    """(id, lanes, component) for each row: rows link as in hamming_links, components take the smallest id reachable.

    Words are maximal runs without ASCII white space, A-Z in lower case. Equal
    fingerprints are one node, so copies cost nothing in the join; nodes are
    numbers, and ids come in only when the classes are there. Null or empty texts
    have fingerprint 0 and link like any other. Every row is a document of its
    own: rows of one id, or without one, are linked by their fingerprints alone.
    Ids are integers; null ids name nothing: where there is no other in a class,
    its component is null. Repeated rows give repeated results; an empty table
    gives an empty table.
    """
    own = cut(fingerprints(docs, id_col, text_col, words, lanes), "fingerprints")
    nodes = cut(own.groupBy("lanes").agg(F.min("id").alias("low")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = connected_components(hamming_links(nodes.select("node", "lanes"), nodes.count(), lanes, budget))
    named = nodes.join(roots, "node", "left").select("lanes", "low", F.coalesce("root", "node").alias("root"))
    named = cut(named, "roots")
    least = named.groupBy("root").agg(F.min("low").alias("component"))
    classes = cut(named.join(spread(least), "root").select("lanes", "component"), "classes")
    return own.join(spread(classes), "lanes").select("id", "lanes", "component")


def shingle_codes(docs: DataFrame, id_col: str, text_col: str, words: int, lanes: int) -> DataFrame:
    """(id long, digest binary, lanes array<long>) for each row: the digest of the word sequence and the MinHash bits of its shingles."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            digest, sets = zip(*(shingles(t, words) for t in batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            codes = np.array([minwise(h, lanes) for h in sets], np.uint64).reshape(-1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(codes.view(np.int64)))], names=["id", "digest", "lanes"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, digest binary, lanes array<long>")


def shingle_sets(asked: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(node, held) of the nodes asked for (node, digest): the shingles of each as sorted 64-bit hashes."""

    def texts(batches):
        for batch in batches:
            lines = [b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(line) for line in lines], pa.binary()), batch.column(0)], names=["digest", "text"])

    def sets(batches):
        for batch in batches:
            got = [shingles(t, words)[1].view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0] + [len(x) for x in got]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*got, np.empty(0, np.int64)])))], names=["node", "held"])

    # copies go before the shuffle, and the join finds its rows dealt out already
    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(texts, "digest binary, text string").groupBy("digest").agg(F.first("text").alias("text"))
    return seen.join(asked, "digest").select("node", "text").mapInArrow(sets, "node long, held array<long>")


def confirmed(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of at least ``similarity``, by exact count."""
    ends = [held.select(F.col("node").alias(c), F.col("held").alias(f"held_{c}")) for c in "ab"]
    both = F.size(F.array_intersect("held_a", "held_b"))
    return pairs.join(ends[0], "a").join(ends[1], "b").where(both / (F.size("held_a") + F.size("held_b") - both) >= similarity).select("a", "b")


def shared_sizes(held: DataFrame) -> DataFrame:
    """(node, size, shared): how many shingles each node has, and how many of them another node has as well."""
    alone = held.select("node", F.explode("held").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return held.select("node", F.size("held").alias("size")).join(alone, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).cast("int").alias("shared"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, budget: int = 6, lanes: int = 7, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each component the document of the smallest id stays.

    The tries only find candidates: lanes of one-bit MinHashes of the five-word
    shingles, one lane within budget bits. At a similarity of 0.8 a bit differs
    with a chance of 0.1 (a SimHash sign: 0.15), a lane is within 6 bits with one
    of 0.54, one of 7 lanes with one of 0.996. Candidates far apart over all
    lanes (beyond 3.3 standard deviations at the similarity) go; those left are
    confirmed by the exact Jaccard similarity of the shingle sets, in two turns:
    first a forest of them, close ones first, so that a large group of near
    copies costs a pair for each text; then every candidate that isn't within one
    confirmed component, but for pairs that can't be similar as one of them has
    too many shingles that no other text has. Texts of the same words (by a
    digest of 128 bits) are one node. Rows of one id are
    one document; rows with a null id stay. Null and empty texts hold the same
    (no) words and are copies. Repeated rows stay or go together; an empty table
    gives an empty table; other columns are carried, whatever their names.
    """
    own = cut(shingle_codes(docs, id_col, text_col, words, lanes), "codes")
    nodes = cut(own.groupBy("digest").agg(F.first("lanes").alias("lanes")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = cut(own.select("id", "digest").join(spread(nodes.select("digest", "node")), "digest").select("id", "node"), "own-nodes")
    mean = 64 * lanes * (1 - similarity) / 2
    far = int(np.ceil(mean + 3.3 * np.sqrt(mean * (1 + similarity) / 2)))
    n = nodes.count()
    tried = cut(hamming_links(nodes.select("node", "lanes"), n, lanes, budget, far, "forest"), "tried")
    # a node with a candidate is in the forest
    asked = cut(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "digest"), "node"), "asked")
    held = cut(shingle_sets(asked, docs, text_col, words), "shingles")
    first = cut(confirmed(tried, held, similarity), "links")
    known = connected_components(first)
    named = nodes.join(shared_sizes(held), "node").join(known, "node", "left").select("node", "lanes", F.coalesce("root", "node").alias("known"), "size", "shared")
    named = cut(named, "named")
    left = hamming_links(named, n, lanes, budget, far, "pairs", similarity=similarity).distinct().join(tried, ["a", "b"], "left_anti")
    links = first.union(confirmed(cut(left, "pairs"), held, similarity))
    # texts of one id that differ are one document
    one = own.where("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    same = own.join(one.where("a <> z"), "id").select("a", F.col("node").alias("b"))
    roots = connected_components(links.union(same))
    classes = cut(own.where("id is not null").select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root")), "classes")
    low = classes.groupBy("root").agg(F.min("id").alias("low"))
    gone = classes.join(spread(low), "root").where("id <> low").select(F.col("id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
