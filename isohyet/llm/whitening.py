"""Embedding whitening: exact distributed covariance, float32 eigenvectors refined by matrix products in higher precision."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm._common import cut, small_batches
from isohyet.llm.itq_dedup import usual_size

LIMB = 20  # bits of a limb: products of two of them add up exactly in doubles for 4,096 rows
MOST = 1 << 40  # entries of the scaled integers are held within this


def refined(v: np.ndarray, turns: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    float32 eigenvectors are the start; every turn adds the correction of Ogita
    and Aishima, which takes two matrix products in extended precision: R = I -
    X'X says how far the columns are from orthonormal, S = X'VX what is left of
    other eigenvectors in each. Pairs whose eigenvalues are closer than the
    uncertainty of S can't be told apart by it: they are only kept orthonormal,
    and once the rest has settled, each chain of them is solved as a small
    problem of its own, shifted by its mean value so that what tells its members
    apart isn't rounded away. Values closer than the rounding of v itself are
    taken as equal; any basis of theirs will do.
    """
    d = len(v)
    scale = float(np.abs(v).max(initial=0.0))
    if not d or not scale:
        return np.zeros(d), np.eye(d)
    a = (v / scale).astype(np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    eye, eps = np.eye(d, dtype=np.longdouble), np.finfo(np.float64).eps
    least = 2 * eps * float(np.linalg.norm(v / scale, 2))
    for _ in range(turns):
        wide_x = x.astype(np.longdouble)
        r = eye - wide_x.T @ wide_x
        s = wide_x.T @ (a @ wide_x)
        s = (s + s.T) / 2  # else rounding over a small gap would move one of a pair only, and they would not stay orthogonal
        value = np.diag(s) / (1 - np.diag(r))
        gap = value[None, :] - value[:, None]
        # what columns have in common, without what they share by not being orthogonal
        common = np.abs(s + (value[None, :] + value[:, None]) / 2 * r).astype(np.float64) * (1 - np.eye(d))
        chains = _chains(value, max(2 * float(np.linalg.norm(common, 2)), least))
        apart = ~np.eye(d, dtype=bool)
        for chain in chains:
            apart[np.ix_(chain, chain)] = False
        step = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        moved = float(np.abs(step).max())
        x = (wide_x + wide_x @ step).astype(np.float64)
        if moved > 1e-6:
            continue
        left = [c for c in chains if float(common[np.ix_(c, c)].max()) > least]
        for chain in left:
            part = x[:, chain].astype(np.longdouble)
            inner = part.T @ (a @ part) - value[chain].mean() * (part.T @ part)
            turned = np.linalg.eigh(((inner + inner.T) / 2 / np.abs(inner).max()).astype(np.float64))[1]
            x[:, chain] = (part @ turned).astype(np.float64)
        # done where steps are below rounding, or hang on what is below the rounding of v by far
        if not left and bool(((np.abs(step) <= 2 * eps) | (common <= least / 100)).all()) and float(np.abs(r).max()) <= 8 * eps:
            break
    wide_x = x.astype(np.longdouble)
    value = ((wide_x * (a @ wide_x)).sum(axis=0) / (wide_x * wide_x).sum(axis=0)).astype(np.float64) * scale
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def _chains(value: np.ndarray, reach: float) -> list[np.ndarray]:
    """Places of values of which each is within reach of the next; single ones are left out."""
    order = np.argsort(value, kind="stable")
    cuts = np.flatnonzero(np.diff(value[order]) > reach) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def added(parts: DataFrame, dtype, at_once: int = 64) -> np.ndarray | None:
    """Sum of equally long arrays, one of each partition (binary column), over as many levels as keep a task at ``at_once`` arrays; None if there are none."""

    def add(batches):
        held = None
        for batch in batches:
            for raw in batch.column(0):
                one = np.frombuffer(raw.as_buffer(), dtype)
                held = one.copy() if held is None else np.add(held, one, out=held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["part"])

    name = parts.columns[0]
    left = parts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // at_once)
        parts = cut(parts, "sums").repartition(left).mapInArrow(add, f"{name} binary")
    rows = parts.collect()
    return np.frombuffer(rows[0][0], dtype) if rows else None


def halves(a: np.ndarray) -> np.ndarray:
    """Whole numbers as two arrays whose sums don't overflow."""
    return np.stack([a >> 32, a & 0xFFFFFFFF])


def whole(a: np.ndarray) -> np.ndarray:
    """Python integers of summed halves."""
    return a[0].astype(object) * (1 << 32) + a[1].astype(object)


@dataclass
class Whitening:
    """Moments of the shifted integers y = x - shift over n vectors, and the components."""

    n: int
    d: int
    shift: np.ndarray
    total: np.ndarray  # of y, Python integers
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    bound: int  # of |y|
    identity_error: float | None = None

    @property
    def live(self) -> np.ndarray:
        """Components that hold variance beyond rounding."""
        return self.values > self.d * np.finfo(np.float64).eps * max(self.trace, 0.0)

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n * x - S for each row, exactly: longs where they fit, else Python integers."""
        if self.n * self.bound * 2 < 1 << 62:
            return self.n * y - self.total.astype(np.int64)
        return self.n * y.astype(object) - self.total

    def whitened(self, y: np.ndarray) -> np.ndarray:
        centred = self.deviations(y).astype(np.float64) / self.n
        live = self.live
        size = np.where(live, np.sqrt(np.where(live, self.values, 1.0)), np.inf)
        return centred @ self.vectors / size


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> tuple[DataFrame, int]:
    """(rows (id, x array<long>) of all vectors that count, their size), written once."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    d = usual_size(own, "vec")
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = own.where(F.coalesce((F.size("vec") == d) & finite, F.lit(False)))
    # clipped before the cast: a long doesn't hold every double
    entry = lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * scale))) + offset)).cast("long")
    return cut(good.select("id", F.transform("vec", entry).alias("x")), "integers"), d


def matrix(batch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit(own: DataFrame, d: int, components: int) -> Whitening | None:
    """The components over all rows; None without rows.

    Three passes: sums, products, and the check of the result. The first two are
    in whole numbers, so their sums are the same however the rows are dealt out
    and whatever task is run again: entries less their rounded mean, in limbs of
    20 bits whose products are exact. Each partition leaves one matrix for each
    pair of limbs (one pair for entries within a million of the mean).
    """

    def sums(batches):
        n, total, low, high = 0, np.zeros((2, d), np.int64), np.full(d, np.iinfo(np.int64).max), np.full(d, np.iinfo(np.int64).min)
        for batch in batches:
            x = matrix(batch, d)
            if len(x):
                n, total = n + len(x), total + halves(x).sum(axis=1)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary()), pa.array([low.min()]), pa.array([high.max()])], names=["n", "total", "low", "high"])

    first = cut(own.mapInArrow(sums, "n long, total binary, low long, high long"), "first-moments")
    n, low, high = first.agg(F.sum("n"), F.min("low"), F.max("high")).first()
    if not n:
        return None
    total = whole(added(first.select("total"), np.int64).reshape(2, d))
    shift = np.array([round(t / n) for t in total], np.int64)
    bound = max(int(high - shift.min()), int(shift.max() - low), 1)
    limbs = -(-(bound.bit_length() + 1) // LIMB)

    def products(batches):
        held = np.zeros((limbs, limbs, 2, d, d), np.int64)
        for batch in batches:
            x = matrix(batch, d)
            for at in range(0, len(x), 4096):
                y = x[at : at + 4096] - shift
                parts = [((y >> (LIMB * k)) if k == limbs - 1 else (y >> (LIMB * k)) & ((1 << LIMB) - 1)).astype(np.float64) for k in range(limbs)]
                for i in range(limbs):
                    for j in range(limbs):
                        held[i, j] += halves((parts[i].T @ parts[j]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["part"])

    got = added(own.mapInArrow(products, "part binary"), np.int64).reshape(limbs, limbs, 2, d, d)
    square = sum(whole(got[i, j]) * (1 << (LIMB * (i + j))) for i in range(limbs) for j in range(limbs))
    rest = np.array([t - n * int(s) for t, s in zip(total, shift)], object)  # sums of y
    exact = n * square - rest[:, None] * rest[None, :]
    cov = np.array([[e / (n * n) for e in row] for row in exact], np.float64)
    values, vectors = refined(cov)
    k = min(components, d)
    out = Whitening(n, d, shift, rest, values[:k], vectors[:, :k], sum(exact.diagonal().tolist()) / (n * n), bound)

    def moments(batches):
        held = np.zeros((k + 1, k))
        for batch in batches:
            x = matrix(batch, d)
            if len(x):
                w = out.whitened(x - shift)
                held[:k] += w.T @ w
                held[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["part"])

    got = added(own.mapInArrow(moments, "part binary"), np.float64).reshape(k + 1, k)
    mean = got[k] / n
    off = np.abs(got[:k] / n - np.outer(mean, mean) - np.eye(k))[np.ix_(out.live, out.live)]
    out.identity_error = float(off.max()) if off.size else None
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(id, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error) for each vector that counts.

    Entries become whole numbers x = floor(scale * c) + offset; the components
    are the eigenvectors of their covariance with the largest eigenvalues (see
    refined), the same signs for all rows. ``deviation`` is the exact sum of (n *
    x - S)^2; ``explained`` the share of each component in the variance.

    Vectors that are null, empty, hold null or non-finite entries, or are not of
    the usual size are left out. Entries beyond 2^40 count as 2^40. Components
    without variance (equal rows, fewer rows than components) have whitened
    values of 0 and don't count in identity_error, which is null if there are no
    others; there are at most as many components as dimensions. Equal eigenvalues
    have some orthonormal basis. A null id stays null; repeated rows are rows like
    any other; a deviation of more than 38 digits is null. An empty table gives
    an empty table; other columns are not read.
    """
    small_batches(vectors.sparkSession)
    own, d = scaled(vectors, id_col, vec_col, scale, offset)
    model = fit(own, d, components)
    kind = "id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return own.sparkSession.createDataFrame([], kind)
    share = (model.values / model.trace if model.trace else np.zeros(len(model.values))).tolist()
    k = len(share)

    def run(batches):
        digits = 10**38
        for batch in batches:
            y = matrix(batch, d) - model.shift
            dev = model.deviations(y)
            if dev.dtype != object and math.isqrt(((1 << 62) - 1) // d) > int(np.abs(dev).max(initial=0)):
                square = pa.array((dev * dev).sum(axis=1)).cast(pa.decimal128(38, 0), safe=True) if len(dev) else pa.array([], pa.decimal128(38, 0))
            else:
                sums = [sum(int(v) ** 2 for v in row) for row in dev.tolist()]
                square = pa.array([str(v) if v < digits else None for v in sums]).cast(pa.decimal128(38, 0))
            rows = batch.num_rows
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.full(rows, model.n)), square, pa.ListArray.from_arrays(offsets, pa.array(model.whitened(y).ravel())), pa.ListArray.from_arrays(offsets, pa.array(share * rows, pa.float64())), pa.array([model.identity_error] * rows, pa.float64())],
                names=["id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.mapInArrow(run, kind)
