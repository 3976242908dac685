"""Line dedup with two Bloom filters."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm._common import cut, small_batches, with_fields, without

SPACE = b" \t\n\x0b\x0c\r"
SEGMENT = 20  # bits of a place within one segment of a filter


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30


def filter_bits(texts: DataFrame, least: int) -> int:
    """Bits of a filter that has eight or more for each line that the texts can hold, as a line of a key takes least + 1 bytes; at most MOST_BITS, which is what every task can be sent."""
    total = texts.agg(F.sum(F.octet_length(texts.columns[0])).alias("n")).first().n or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (8 * (total // (least + 1))).bit_length()))


def _keys(text: str | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text as UTF-8, and the key of each that is long enough."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys = [k if len(k := x.strip(SPACE).lower()) >= least and (k.isascii() or len(k.decode("utf-8", "replace")) >= least) else None for x in lines]
    return lines, keys


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Two places of the filter for each hash."""
    m = np.uint64(bits - 1)
    return np.stack([h & m, (h >> np.uint64(33)) & m])


def _pack(at: np.ndarray) -> bytes:
    return zlib.compress(at.astype("<u4").tobytes(), 1)


def _partial(bits: int, least: int):
    """Each task's part of both filters, as places by segment."""

    def parts(batches):
        once = np.empty(0, np.uint64)
        twice = np.empty(0, np.uint64)
        for batch in batches:
            got = []
            for text in batch.column(0).to_pylist():
                got += {xxhash.xxh64_intdigest(k) for k in _keys(text, least)[1] if k is not None}
            u, n = np.unique(np.array(got, np.uint64), return_counts=True)
            twice = np.union1d(twice, np.concatenate([u[n > 1], np.intersect1d(u, once, assume_unique=True)]))
            once = np.union1d(once, u)
        u, n = np.unique(_places(once, bits), return_counts=True)
        marked = {0: u, 1: np.union1d(u[n > 1], _places(twice, bits).ravel())}
        rows = {}
        for which, at in marked.items():
            seg = (at >> np.uint64(SEGMENT)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(seg, prepend=-1)) if len(at) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
                rows.setdefault(int(seg[lo]), [b"", b""])[which] = _pack(at[lo:hi] & np.uint64((1 << SEGMENT) - 1))
        salt = TaskContext.get().partitionId() % 64
        k = sorted(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array([salt] * len(k), pa.int32()), *(pa.array([rows[s][w] for s in k], pa.binary()) for w in (0, 1))],
            names=["seg", "salt", "once", "twice"],
        )

    return parts


def _merge(batches):
    """Merge parts of the filters that come sorted by (seg, salt); a place seen in two parts has been seen twice."""

    def out(key, once, twice):
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([_pack(np.flatnonzero(x))], pa.binary()) for x in (once, twice))],
            names=["seg", "salt", "once", "twice"],
        )

    key = None
    for batch in batches:
        for seg, salt, a, b in zip(*(batch.column(c).to_pylist() for c in ("seg", "salt", "once", "twice"))):
            if (seg, salt) != key:
                if key is not None:
                    yield out(key, once, twice)
                key, once, twice = (seg, salt), np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
            for data, own in ((a, True), (b, False)):
                if data:
                    at = np.frombuffer(zlib.decompress(data), "<u4")
                    if own:
                        twice[at[once[at]]] = True
                        once[at] = True
                    else:
                        twice[at] = True
    if key is not None:
        yield out(key, once, twice)


def twice_seen(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """The twice-seen filter over all lines of a one-column frame, as packed bits: bits / 8 bytes whatever the input."""
    schema = "seg int, salt int, once binary, twice binary"
    part = texts.mapInArrow(_partial(bits, least), schema)
    for by in (("seg", "salt"), ("seg",)):
        part = part if by != ("seg",) else part.withColumn("salt", F.lit(0))
        part = part.repartition(*by).sortWithinPartitions("seg", "salt").mapInArrow(_merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    wide = 1 << (SEGMENT - 3)
    for row in part.select("seg", "twice").toLocalIterator():
        one = np.zeros(1 << SEGMENT, bool)
        if row.twice:
            one[np.frombuffer(zlib.decompress(bytes(row.twice)), "<u4")] = True
        out[row.seg * wide : (row.seg + 1) * wide] = np.packbits(one, bitorder="little")
    return out


def _suspects(keys: list[bytes | None], filter_bits: np.ndarray, bits: int) -> dict[bytes, bytes]:
    """Key -> digest for the keys whose two places are both marked."""
    some = list({k for k in keys if k is not None})
    if not some:
        return {}
    at = _places(np.fromiter((xxhash.xxh64_intdigest(k) for k in some), np.uint64, len(some)), bits)
    hit = ((filter_bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
    return {some[i]: hashlib.blake2b(some[i], digest_size=16).digest() for i in np.flatnonzero(hit)}


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    bits: int | None = None,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """docs with repeated lines taken out of the text, and with n_lines and n_dropped at the end.

    A line's key is the line without ASCII white space at its ends, A-Z in lower
    case. Keys of at least min_chars code points that stand in at least min_docs
    documents lose their lines in all documents but that of the largest id.

    Two Bloom filters of ``bits`` bits (once and twice seen; see filter_bits where
    none are given) are built in the tasks, merged by segment, and only the
    twice-seen one is sent out. Lines that
    miss it never leave their task; the others shuffle as a 128-bit BLAKE2b
    digest and an id, for exact counts and the choice of the document that keeps
    the line. Beyond some 10^8 long lines the
    filter fills up, and more lines are suspected and shuffle, in the end all of
    them; results don't change. Decisions up to broadcast_rows
    are sent to the tasks; more are joined by document.

    Null texts are empty texts: one empty line. Rows of one id (also null) are
    one document, and null is the smallest id. Columns named n_lines or n_dropped
    in the input are replaced. Repeated lines within one document count once and
    go or stay together. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bits = bits or filter_bits(docs.select(text_col), min_chars)
    sent = spark.sparkContext.broadcast(twice_seen(docs.select(text_col), bits, min_chars))
    id_type = docs.schema[id_col].dataType

    def suspected(batches):
        for batch in batches:
            ids, keys = [], []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _suspects(_keys(text, min_chars)[1], sent.value, bits).values()
                keys += found
                ids += [one] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, batch.schema.field(0).type)], names=["key", "id"])

    pairs = docs.select(id_col, text_col).mapInArrow(suspected, T.StructType([T.StructField("key", T.BinaryType()), T.StructField("id", id_type)])).distinct()
    decided = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("key", "keep")
    decided = cut(decided, "line-decisions")
    few = decided.limit(broadcast_rows + 1).count() <= broadcast_rows
    rest = without(docs, "n_lines", "n_dropped")
    if few:
        chosen = decided.toArrow()
        keep = spark.sparkContext.broadcast(dict(zip(chosen.column("key").to_pylist(), chosen.column("keep").to_pylist())))
    else:
        keep = None
        drops = pairs.join(decided, "key").where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("id").agg(F.collect_list("key").alias("drops__"))
        rest = rest.join(drops, rest[id_col].eqNullSafe(drops["id"]), "left").drop(drops["id"])
    out = with_fields(docs.schema, ("n_lines", T.LongType()), ("n_dropped", T.LongType()))
    names = [f.name for f in out.fields]

    def apply(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            own = batch.column("drops__").to_pylist() if keep is None else [None] * batch.num_rows
            for one, text, gone in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist(), own):
                lines, keys = _keys(text, min_chars)
                digests = _suspects(keys, sent.value, bits)
                if keep is None:
                    gone = set(gone or ())
                    bad = {k for k, d in digests.items() if d in gone}
                else:
                    bad = {k for k, d in digests.items() if d in keep.value and keep.value[d] != one}
                kept = [x for x, k in zip(lines, keys) if k not in bad] if bad else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept).decode("utf-8", "replace") if bad else text or "")
            cols = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), text_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[n] if n in cols else batch.column(n) for n in names], names=names)

    return rest.mapInArrow(apply, out)
