"""Byte-level BPE by a reduction over a balanced tree of text pieces."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from isohyet.llm._common import small_batches, with_fields, without

#: Between a character that isn't white space and a space or line feed, every encoding has a match boundary: no
#: alternative of the pattern spans that place, and none looks behind. So ids before and after it never change.
EDGE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Monoid of encoded pieces: encode() of any text, join() of neighbours."""

    def __init__(self, path: str, pattern: str, leaf: int = 8192, window: int = 256):
        self.bpe, self.leaf, self.window = codec(path, pattern), leaf, window
        self.width = np.array([len(self.bpe.decode_single_token_bytes(i)) for i in range(self.bpe.n_vocab)], np.int64)

    def encode(self, text: str) -> np.ndarray:
        """The ids of the text: each half by itself, then joined."""
        return self._tree(text, 0, len(text))

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.bpe.encode_ordinary(text), np.uint32)

    def _tree(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """ids of text[lo:hi] from those of its parts. The window around mid grows until both its ends lie at an EDGE or an end of the text: ids outside stay."""
        w = self.window
        while True:
            a, b = max(lo, mid - w), min(hi, mid + w)
            first = next((m.start() for m in reversed(list(EDGE.finditer(text, max(lo + 1, a), mid)))), None) if a > lo else lo
            last = next((m.start() for m in EDGE.finditer(text, mid + 1, b)), None) if b < hi else hi
            if first is not None and last is not None:
                break
            w *= 2
        mine = text[first:mid].encode("utf-8", "surrogatepass")
        other = text[mid:last].encode("utf-8", "surrogatepass")
        return np.concatenate([left[: self._cut(left[::-1], len(mine), len(left))], self._leaf(text[first:last]), right[len(right) - self._cut(right, len(other), len(right)) :]])

    def _cut(self, ids: np.ndarray, size: int, total: int) -> int:
        """How many of the ids stay when those of the first ``size`` bytes go."""
        gone, seen, step = 0, 0, 256
        while seen < size:
            ends = np.cumsum(self.width[ids[gone : gone + step]]) + seen
            at = int(np.searchsorted(ends, size))
            if at < len(ends):
                assert ends[at] == size, "an id crosses a match boundary"
                return total - gone - at - 1
            gone, seen = gone + len(ends), int(ends[-1])
        return total - gone

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: halves decoded by themselves and concatenated."""
        if len(ids) <= self.leaf:
            return self.bpe.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def byte_bpe(docs: DataFrame, path: str, pattern: str, text_col: str = "text", leaf: int = 8192) -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit, as binary), n_tokens and decoded (binary) at the end.

    ids are those that the ranks in ``path`` give for each match of ``pattern``,
    without special tokens. A null or empty text has no ids; repeated rows are
    encoded one by one. Columns of these
    names in the input are replaced; an empty table gives an empty table. The
    rank file is read on the executors, where the same package is installed.
    No shuffle: a document is encoded where it is read, in memory of its own size.
    """
    small_batches(docs.sparkSession)
    new = ("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.BinaryType())
    out = with_fields(docs.schema, *new)

    def run(batches):
        enc = Encoder(path, pattern, leaf)
        names = [f.name for f in out.fields]
        for batch in batches:
            ids, back = [], []
            for text in batch.column(text_col).to_pylist():
                got = enc.encode(text or "")
                ids.append(got)
                back.append(enc.decode(got))
            cols = {"ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "decoded": pa.array(back, pa.binary())}
            yield pa.RecordBatch.from_arrays([cols[n] if n in cols else batch.column(n) for n in names], names=names)

    return without(docs, *(n for n, _ in new)).mapInArrow(run, out)
