"""Quality classifier: regularised quadratic discriminant on document statistics."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm._common import small_batches, with_fields, without

NAMES = (
    "log_words", "log_word_length", "log_line_length", "log_words_per_stop", "upper", "digits", "symbols", "bangs", "bars", "other_marks",
    "no_letter_words", "marked_words", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "longest_word", "line_ends",
)
MARKS = {name: np.frombuffer(chars, np.uint8) for name, chars in {"digits": b"0123456789", "symbols": b"#$%&*@^~", "bangs": b"!?", "bars": b"|<>{}[]\\=_", "other_marks": b"\"'()+-/:;`"}.items()}


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


BLANK = _table(b" \t\n\x0b\x0c\r")
LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
MARKED = _table(b"#$%&*!|@^~")
STOP = _table(b".!?")
ODD = np.uint64(0x9E3779B97F4A7C15)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES; an empty text has those of zero counts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    data = np.frombuffer(raw, np.uint8)
    count = np.bincount(data, minlength=256)
    turn = np.flatnonzero(np.diff(~BLANK[data], prepend=False, append=False))
    begin, end = turn[::2], turn[1::2]
    n = max(1, len(begin))
    wide = end - begin
    in_words = np.concatenate([[0], np.cumsum(LETTER[data])])
    hashed = np.fromiter(map(hash, raw.lower().split()), np.int64, len(begin)).view(np.uint64)
    _, seen = np.unique(hashed, return_counts=True)
    pairs = len(np.unique(hashed[:-1] * ODD + hashed[1:]))
    lines = [x for x in raw.split(b"\n") if x]
    upper = int(count[65:91].sum())
    letters = upper + int(count[97:123].sum()) + int(count[192:].sum())
    stops = int(count[46] + count[33] + count[63])
    root = math.sqrt
    return [
        math.log1p(len(begin)),
        math.log1p(int(wide.sum()) / n),
        math.log1p(size / max(1, len(lines))),
        math.log1p(n / (1 + stops)),
        root(upper / max(1, letters)),
        *(root(int(count[m].sum()) / size) for m in MARKS.values()),
        root(int((in_words[end] == in_words[begin]).sum()) / n),
        root(int(MARKED[data[end - 1]].sum()) / n),
        root(1 - len(seen) / n),
        root(int(seen.max(initial=0)) / n),
        root(1 - pairs / (len(begin) - 1)) if len(begin) > 1 else 0.0,
        root(1 - len(set(lines)) / max(1, len(lines))),
        math.log1p(int(wide.max(initial=0))),
        root(sum(STOP[x[-1]] for x in lines) / max(1, len(lines))),
    ]


def held_out(id_value, folds: int = 5) -> bool:
    """Whether a document is never learnt from: crc32 of its id as text, modulo folds, is 0."""
    return zlib.crc32(("" if id_value is None else str(id_value)).encode()) % folds == 0


@dataclass
class Model:
    """Per class: mean, inverse Cholesky factor of the shrunk covariance, half its log-determinant and log prior; the scaling before them."""

    shift: np.ndarray
    scale: np.ndarray
    mean: list
    factor: list
    log_det: list
    log_prior: list
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the two log-densities."""
        z = np.clip((x - self.shift) / self.scale, -8, 8)
        part = []
        for c in (0, 1):
            d = (z - self.mean[c]) @ self.factor[c].T
            part.append(self.log_prior[c] - self.log_det[c] - 0.5 * (d * d).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(-self.temper * (part[1] - part[0]), -60, 60)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.15, ridge: float = 0.05, temper: float = 0.25) -> Model:
    """From count, sum and sum of products of each class. A class without rows takes the other's moments and a prior of one row."""
    d = len(NAMES)
    empty = (0.0, np.zeros(d), np.zeros((d, d)))
    sums = {c: sums.get(c, empty) for c in (0, 1)}
    n = sum(s[0] for s in sums.values())
    if not n:
        sums = {c: (1.0, np.zeros(d), np.eye(d)) for c in (0, 1)}
        n = 2.0
    shift = sum(s[1] for s in sums.values()) / n
    scale = np.sqrt(np.maximum(np.diag(sum(s[2] for s in sums.values())) / n - shift**2, 1e-6))
    stats = {}
    for c, (m, s, p) in sums.items():
        if m:
            mean = (s / m - shift) / scale
            stats[c] = m, mean, ((p / m - np.outer(shift, s / m) - np.outer(s / m, shift) + np.outer(shift, shift)) / np.outer(scale, scale)) - np.outer(mean, mean)
    pooled = sum(m * cov for m, _, cov in stats.values()) / n
    for c in (0, 1):
        if c not in stats:
            stats[c] = (1.0, *stats[1 - c][1:])
    out = {"mean": [], "factor": [], "log_det": [], "log_prior": []}
    for c in (0, 1):
        m, mean, cov = stats[c]
        mixed = (1 - shrink) * cov + shrink * pooled
        mixed = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / d, 1e-3) * np.eye(d)
        chol = np.linalg.cholesky(mixed)
        out["mean"].append(mean)
        out["factor"].append(np.linalg.inv(chol))
        out["log_det"].append(float(np.log(np.diag(chol)).sum()))
        out["log_prior"].append(math.log(m / sum(x[0] for x in stats.values())))
    return Model(shift, scale, temper=temper, **out)


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "statistics") -> DataFrame:
    """docs with an array of the statistics at the end."""
    small_batches(docs.sparkSession)
    out = with_fields(docs.schema, (name, T.ArrayType(T.DoubleType())))
    names = [f.name for f in out.fields]

    def run(batches):
        for batch in batches:
            got = pa.array([statistics(t) for t in batch.column(text_col).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([got if n == name else batch.column(n) for n in names], names=names)

    return without(docs, name).mapInArrow(run, out)


def class_sums(labelled: DataFrame, folds: int = 5) -> dict:
    """(id, quality, statistics) -> count, sum and sum of products of each class, without held-out rows.

    Summed in the tasks first; one row of fixed size for each task and class goes on, and Spark adds those up by place.
    """
    d = len(NAMES)

    def run(batches):
        acc = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            label = batch.column(1).to_pylist()
            use = [i for i, v in enumerate(batch.column(0).to_pylist()) if label[i] in (0, 1) and not held_out(v, folds)]
            if use:
                x = np.array(batch.column(2).take(pa.array(use)).to_pylist(), np.float64)
                y = np.array([label[i] for i in use])
                for c in (0, 1):
                    z = x[y == c]
                    acc[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], acc.shape[1]).astype(np.int32)), pa.array(np.tile(np.arange(acc.shape[1]), 2).astype(np.int32)), pa.array(acc.ravel())], names=["c", "at", "v"])

    rows = labelled.mapInArrow(run, "c int, at int, v double").groupBy("c", "at").agg(F.sum("v").alias("v")).collect()
    acc = np.zeros((2, 1 + d + d * d))
    for r in rows:
        acc[r.c, r.at] = r.v
    return {c: (a[0], a[1 : 1 + d], a[1 + d :].reshape(d, d)) for c, a in enumerate(acc) if a[0] > 0}


def train(with_stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", name: str = "statistics", folds: int = 5) -> Model:
    """Fit on every labelled row of the training folds; no sample, as the sums have a fixed size."""
    # an id with two different labels teaches nothing, one with the same label twice counts once
    known = labels.where("quality is not null").groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("id", "quality")
    rows = with_stats.select(F.col(id_col).alias("id"), F.col(name).alias("x")).join(known, "id").select("id", "quality", "x")
    return fit(class_sums(rows, folds))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with quality_score (double) at the end: probability of label 1. Null or empty texts get one too; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    out = with_fields(docs.schema, ("quality_score", T.DoubleType()))
    names = [f.name for f in out.fields]

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            got = model.score(np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(NAMES)))
            yield pa.RecordBatch.from_arrays([pa.array(got) if n == "quality_score" else batch.column(n) for n in names], names=names)

    return without(docs, "quality_score").mapInArrow(run, out)


def score_statistics(rows: DataFrame, model: Model, id_col: str = "doc_id", name: str = "statistics") -> DataFrame:
    """(id, held_out, score) of rows that hold their statistics already."""

    def run(batches):
        for batch in batches:
            got = model.score(np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(v) for v in batch.column(0).to_pylist()], pa.bool_()), pa.array(got)], names=[id_col, "held_out", "score"])

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    return rows.select(id_col, name).mapInArrow(run, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least threshold, in docs' own columns.

    The model learns from the labelled rows of docs outside the held-out fold.
    Neither ids nor labels are inputs of a score. Labels for unknown or null ids,
    labels other than 0 and 1 and ids of contradicting labels are ignored, a
    repeated label counts once; without any labels all
    documents score 0.5 and stay. The text is read twice (learn, then score)
    rather than shuffled.
    """
    model = train(with_statistics(docs.select(id_col, text_col), text_col).drop(text_col), labels, id_col)
    # a column of the score's name in docs is kept under another one
    clash = {c: f"{c}__kept" for c in docs.columns if c.lower() == "quality_score"}
    scored = score_documents(docs.withColumnsRenamed(clash), model, text_col).where(F.col("quality_score") >= threshold).drop("quality_score")
    return scored.withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
