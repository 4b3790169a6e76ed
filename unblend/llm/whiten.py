"""Whitening of vectors by their leading principal components, found with LOBPCG.

The covariance matrix is never formed. What the method asks of the data is its product with a few columns, and
that is one pass: every task centres its rows, multiplies them with the columns and then the transposed rows with
what comes out, and hands on dimensions x columns numbers, which Spark adds up. The driver holds blocks of
so many numbers. Each round searches the span of the block, its residuals and the directions it last moved in
(Rayleigh-Ritz), until a fresh product certifies that the residuals of the wanted components are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import integer_table


class Centred:
    """Rows of integers and what centres them: n rows with sums ``sums``."""

    def __init__(self, rows: DataFrame, dims: int):
        self.rows, self.dims = rows.select("x"), dims
        self.n, self.sums = 0, [0] * dims
        for r in self._sums().collect():  # a number a dimension
            if r.at < 0:
                self.n = int(r.total)
            else:
                self.sums[r.at] = int(r.total)

    def _sums(self) -> DataFrame:
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(dims, np.int64)
            for batch in batches:
                x = block(batch, dims)
                n, total = n + len(x), total + x.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.append(n, total))], names=["at", "total"])

        return self.rows.mapInArrow(run, "at long, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole and fractional parts of the means: an integer less the first is exact."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - q * self.n) / self.n for s, q in zip(self.sums, whole)])

    def times(self, columns: np.ndarray) -> np.ndarray:
        """The covariance matrix times the columns, centred before multiplying, in one pass over the rows."""
        (whole, rest), n, k = self.centre(), self.n, columns.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(columns.shape)
            for batch in batches:
                x = (block(batch, len(whole)) - whole) - rest
                total += x.T @ (x @ columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole))), *[pa.array(total[:, j]) for j in range(k)]], names=["at", *[f"c{j}" for j in range(k)]])

        schema = "at long, " + ", ".join(f"c{j} double" for j in range(k))
        got = self.rows.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)])
        out = np.zeros(columns.shape)
        for r in got.collect():  # dimensions x columns numbers
            out[r["at"]] = r[1:]
        return out / n

    def trace(self) -> float:
        """The sum of all variances."""
        whole, rest = self.centre()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((float((((block(b, len(whole)) - whole) - rest) ** 2).sum()) for b in batches), 0.0)
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["total"])

        return self.rows.mapInArrow(run, "total double").agg(F.sum("total")).first()[0] / self.n


def block(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The batch's vectors as rows of a matrix."""
    return batch.column("x").flatten().to_numpy().reshape(len(batch), dims)


def _orthonormal(z: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to the basis ``against``."""
    for _ in range(2):
        z = z - against @ (against.T @ z)
        size = np.linalg.norm(z, axis=0)
        z = z[:, size > 0] / size[size > 0]
        if not z.shape[1]:
            return z
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        z = u[:, s > 1e-8]
    return z


def lobpcg(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, guard: int = 8, tol: float = 1e-13, rounds: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, eigenvectors X, and its product with them.

    ``times`` multiplies the matrix with a block of columns. ``guard`` further columns are iterated along, which keeps
    convergence fast where eigenvalues lie close. Ends when a product made afresh has all wanted residuals at or below
    ``tol`` times the largest eigenvalue; if they aren't after so many ``rounds``, that is an error.
    """
    m = min(dims, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, m)))[0]
    vx, moved, fresh = times(x), np.zeros((dims, 0)), True
    for _ in range(rounds):
        e, y = np.linalg.eigh((x.T @ vx + vx.T @ x) / 2)
        x, vx, e = x @ y[:, ::-1], vx @ y[:, ::-1], e[::-1]
        left = vx - x * e
        if np.linalg.norm(left[:, :wanted], axis=0).max() <= tol * max(abs(e[0]), np.finfo(float).tiny):
            if fresh:
                return e[:wanted], x[:, :wanted], vx[:, :wanted]
            x = np.linalg.qr(x)[0]
            vx, fresh = times(x), True
            continue
        z = _orthonormal(np.hstack([left, moved]), x)
        if not z.shape[1]:  # the block spans all: only rounding is left
            x = np.linalg.qr(x)[0]
            vx, fresh = times(x), True
            continue
        vz = times(z)
        s, vs = np.hstack([x, z]), np.hstack([vx, vz])
        h = s.T @ vs
        _, y = np.linalg.eigh((h + h.T) / 2)
        y = y[:, ::-1][:, :m]
        moved = z @ y[m:]
        x, vx, fresh = s @ y, vs @ y, False
    raise RuntimeError(f"residuals are above {tol:g} of the largest eigenvalue after {rounds} rounds")


RESULT = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}


def whiten(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000, guard: int = 8, tol: float = 1e-13
) -> DataFrame:
    """Per usable row and component: ``id_col``, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite components are dropped, as are vectors of other
    dimensions than most; all others are fitted on, repeated rows as often as they are there. Components become
    x = floor(scale * c) + shift. ``deviation`` is the sum of (n * x - S)^2 with S the dimension's sum, exact. ``whitened`` is the centred
    row projected on the unit eigenvector of the covariance (divisor n), over the root of its eigenvalue;
    ``explained`` the eigenvalue's share of the trace; ``identity_error`` how far the whitened rows' covariance is from the identity at most. There are at most as many components as
    dimensions, and none for directions in which rows don't differ, so rows that are all alike, a single row or an empty table give none.
    Null ids stay as they are. Other columns are ignored, whatever their names.
    """
    rows, dims = integer_table(df, id_col, vec_col, scale, shift)
    none = df.sparkSession.createDataFrame([], df.select(id_col).schema)
    empty = none.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in RESULT.items()])
    if not dims:
        return empty
    data = Centred(rows, dims)
    trace = data.trace()
    if not trace > 0:
        return empty
    e, u, vu = lobpcg(data.times, dims, min(components, dims), guard, tol)
    k = int((e > 1e-12 * trace).sum())
    e, u, vu = e[:k], u[:, :k], vu[:, :k]
    root = np.sqrt(e)
    error = float(np.abs(u.T @ vu / np.outer(root, root) - np.eye(k)).max())
    (whole, rest), n, scaled = data.centre(), data.n, u / root
    sums, explained = data.sums, e / trace
    # n * x - S = n * (x - whole) - (S - n * whole)
    odd = np.array([s - n * int(q) for s, q in zip(sums, whole)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = block(batch, dims) - whole
            most = n * (int(np.abs(x).max(initial=0)) + 1)
            gap = (x if most < 1 << 62 else x.astype(object)) * n - odd
            gap = gap if dims * most * most < 1 << 63 else gap.astype(object)
            far = (gap * gap).sum(1)
            z = (x - rest) @ scaled
            at = np.repeat(np.arange(len(x)), k)
            cols = [
                batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)),
                pa.array([int(v) for v in far.tolist()], pa.decimal128(38, 0)).take(pa.array(at)), pa.array(z.reshape(-1)),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in RESULT.items())).withColumnRenamed("id", id_col)
