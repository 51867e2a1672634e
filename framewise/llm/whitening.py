"""Embedding whitening by QDWH spectral divide and conquer.

Spark makes the statistics of all rows: count and exact sums, then the covariance of the centred rows, each task one matrix.
The covariance, a square of the dimension, is taken apart on the driver: the polar factor U of V - sI, by QR-based dynamically
weighted Halley steps, gives the projector (U + I) / 2 on the eigenvectors above s; an orthonormal basis of its range and of
the rest turns V into two smaller blocks, which are divided alike until single components are left. The transformation, a
matrix of dimension by components, is broadcast and all rows are whitened where they are.

Entries become integers floor(scale * c) + shift. Rows are centred around the rounded mean as integers and then by the rest
of the mean, so that no digits are lost to the shift.

Edge cases: vectors that are null or hold null or non-finite entries are dropped; shorter ones end in zero entries. Repeated
rows count as often as they stand. A component without variance (eigenvalue not above the rounding of the largest) has null
as whitened and stays out of identity_error. A deviation that does not fit a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import share
from .vectors import matrix

EPS = float(np.finfo(float).eps)
#: Largest dimension: the driver holds a few square matrices of it.
MOST_DIMENSIONS = 4096


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH."""
    n = len(a)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    low, eye = EPS / n, np.eye(n)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
        new = b / c * x + (h - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (h + b * low**2) / (1 + c * low**2))
        if moved < EPS ** (1 / 3) and abs(1 - low) < 10 * EPS:
            break
    return x


def halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces of a symmetric matrix; None where it is a multiple of the identity up to rounding."""
    n, eye, rng = len(a), np.eye(len(a)), np.random.default_rng(n := len(a))
    values = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.trace(a) / n * eye)
    if spread <= n * EPS * scale:
        return None
    best = None
    # the mean of the eigenvalues always lies between them; the median of the diagonal divides more evenly
    for s in [np.median(values), np.trace(a) / n, *(np.trace(a) / n + spread * rng.uniform(-0.5, 0.5, 16) / n)]:
        p = (polar(a - s * eye) + eye) / 2
        k = round(float(np.sum(p * p)))
        if not 0 < k < n:
            continue
        q = np.linalg.qr(np.hstack([p @ rng.standard_normal((n, k)), (eye - p) @ rng.standard_normal((n, n - k))]))[0]
        for _ in range(3):
            off = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
            if best is None or off < best[0]:
                best = off, q[:, :k], q[:, k:]
            if off <= n * EPS * scale:
                return best[1:]
            q = np.linalg.qr(np.hstack([p @ q[:, :k], (eye - p) @ q[:, k:]]))[0]
        if best[0] <= 100 * n * EPS * scale:
            break
    return None if best is None else best[1:]


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix by spectral divide and conquer."""
    n, scale, parts = len(v), float(np.linalg.norm(v)), []
    stack = [np.eye(n)] if n else []
    while stack:
        w = stack.pop()
        a = w.T @ v @ w
        a = (a + a.T) / 2
        if w.shape[1] == 1 or (two := halves(a, scale)) is None:
            parts.append(w)
        else:
            stack += [np.linalg.qr(w @ h)[0] for h in two]
    w = np.hstack(parts) if parts else np.zeros((0, 0))
    e = np.einsum("ij,ij->j", w, v @ w)
    order = np.argsort(-e, kind="stable")
    return e[order], w[:, order]


class Center:
    """Count, exact sums and what follows from them."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.near = np.array([round(Fraction(s, n)) for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s, n) - round(Fraction(s, n))) for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2 for each row, exact."""
        y = x - self.near
        rest = [s - self.n * int(c) for s, c in zip(self.sums, self.near)]
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
        if most**2 * max(1, x.shape[1]) < 2**63:
            d = self.n * y - np.array(rest, np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        exact = [sum((self.n * int(c) - r) ** 2 for c, r in zip(row, rest)) for row in y]
        return [d if d < 2**63 else None for d in exact]


def _integers(column: pa.Array, scale: int, shift: int, dim: int = 0) -> tuple[np.ndarray, np.ndarray]:
    usable, x = matrix(column, dim)
    return usable, np.floor(scale * x).astype(np.int64) + shift


def center(vectors: DataFrame, scale: int, shift: int) -> Center | None:
    """Count and sums over all usable rows of vectors (id, v); None without any. Of each task one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, object)
        for batch in batches:
            _, x = _integers(batch.column(1), scale, 0)
            n += len(x)
            if x.shape[1] > len(sums):
                sums = np.concatenate([sums, np.zeros(x.shape[1] - len(sums), object)])
            sums[: x.shape[1]] += x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums), dtype=np.int32)), pa.array([n, *map(int, sums)], pa.int64())], names=["d", "s"])

    got = {r["d"]: int(r["s"]) for r in vectors.mapInArrow(run, "d int, s bigint").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    if not got:
        return None
    n, dim = got.pop(-1), len(got)
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"{dim} dimensions; {MOST_DIMENSIONS} at most")
    return Center(n, [got[d] + n * shift for d in range(dim)])


def covariance(vectors: DataFrame, load, width: int, rows) -> np.ndarray:
    """Mean of the outer products of the rows that `rows(load(), column)` makes of vectors (id, v), of the given width; of each task one upper triangle."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gram = 0, np.zeros((width, width))
        for batch in batches:
            y = rows(load(), batch.column(1))
            n += len(y)
            gram += y.T @ y
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(upper[0]), dtype=np.int32)), pa.array(np.concatenate([[n], gram[upper]]))], names=["at", "s"])

    got = vectors.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    s = dict(zip(got.column("at").to_pylist(), got.column("s").to_pylist()))
    v = np.zeros((width, width))
    v[upper] = [s[i] / s[-1] for i in range(len(upper[0]))]
    return v + np.triu(v, 1).T


class Whitener:
    """The fitted transformation: centre, eigenvalues, and the matrix that rows are multiplied with."""

    def __init__(self, mean: Center, values: np.ndarray, vectors: np.ndarray, components: int):
        self.mean = mean
        positive = values > len(values) * EPS * max(values[0], 0.0) if len(values) else values > 0
        self.count = min(components, len(values))
        self.firm = int(positive[: self.count].sum())
        total = float(values.sum())
        self.explained = [float(e) / total if total > 0 else 0.0 for e in values[: self.count]]
        self.map = vectors[:, : self.firm] / np.sqrt(values[: self.firm])


def fit(vectors: DataFrame, components: int, scale: int, shift: int) -> tuple[Whitener, float] | None:
    """The whitening of vectors (id, v) and its identity error, measured over all whitened rows."""
    spark = vectors.sparkSession
    mean = center(vectors, scale, shift)
    if mean is None:
        return None
    dim = len(mean.sums)
    v = covariance(vectors, share(spark, mean), dim, lambda m, c: m.centred(_integers(c, scale, shift, dim)[1]))
    white = Whitener(mean, *spectrum(v), components)
    if not white.firm:
        return white, 0.0
    z = covariance(vectors, share(spark, white), white.firm, lambda w, c: w.mean.centred(_integers(c, scale, shift, dim)[1]) @ w.map)
    return white, float(np.abs(z - np.eye(white.firm)).max())


def whitened(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(<id>, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component, numbered from 1 by falling eigenvalue.

    vectors is read four times: a stored table, or one that is cheap to make again and always the same.
    """
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{embedding}`").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"`{id}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fitted = fit(rows, components, scale, shift)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], out)
    white, error = fitted
    load, dim = share(rows.sparkSession, white), len(white.mean.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = load()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                usable, x = _integers(part.column(1), scale, shift, dim)
                z = np.full((len(x), w.count), np.nan)
                z[:, : w.firm] = w.mean.centred(x) @ w.map
                values = pa.array(z.ravel(), pa.float64(), from_pandas=True)  # NaN stands for null
                offsets = pa.array(np.arange(0, z.size + 1, w.count, dtype=np.int32)) if w.count else pa.array(np.zeros(len(x) + 1, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.flatnonzero(usable))), pa.array(w.mean.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["id", "deviation", "z"])

    z = rows.mapInArrow(run, f"id {kind}, deviation bigint, z array<double>").select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    share_of = F.element_at(F.array(*map(F.lit, white.explained or [0.0])), F.col("at") + 1)
    return z.select(F.col("id").alias(id), (F.col("at") + 1).alias("component"), F.lit(white.mean.n).cast("bigint").alias("n"), "deviation", "whitened", share_of.alias("explained"), F.lit(error).alias("identity_error"))
