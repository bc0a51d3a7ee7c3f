"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

The n x d matrix X has a row for every usable vector, made whole numbers (``SCALE`` steps a unit) so that
sums are exact, less the mean. The method builds orthonormal v1, v2, ... and u1, u2, ... with

    X v_j = beta_(j-1) u_(j-1) + alpha_j u_j        X' u_j = alpha_j v_j + beta_j v_(j+1)

by alternating distributed products, every new vector being made orthogonal to all earlier ones. The
singular values and right vectors of the small bidiagonal matrix of alphas and betas approach
those of X: components and deviations. It ends when the wanted ones have converged to working
precision, at the latest after d steps, when the bidiagonal matrix has the very singular values of X.

The u_j have a number for every row and never leave the tasks: each lies in the range of X, so the driver
keeps u_j = X w_j by its d numbers w_j and a task computes its part of u_j from its rows. One step is two
passes over the rows: the first gives the products of X v with all earlier u, the second, with these taken
out, the norm, what is left of the products, and X' u. A task sends back some vectors of d numbers; at most
``PARTS`` tasks run a pass, which bounds what reaches the driver by the dimensions alone.

Defined cases: rows whose vector is NULL, empty or holds a NULL or non-finite entry, or one whose whole
number does not fit into 53 bits, are left out; so are rows whose vector is not as long as most (the longest
of equally common lengths). Repeated rows count each. Axes without variance (beyond rounding) give no
component, so constant tables and single vectors give no rows. A deviation beyond a long is NULL. NULL ids
are carried along and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickfold.llm.common import small_batches, stored

SCALE, OFFSET = 1024, 100_000
#: Tasks of a pass; each sends a few vectors to the driver.
PARTS = 2048
_EPS = float(np.finfo(np.float64).eps)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, x): the usable vectors as whole numbers, packed as 64-bit integers."""
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("dim", T.IntegerType()),
                           T.StructField("x", T.BinaryType())])

    def batches(it):
        for batch in it:
            column = batch.column(1)
            flat = column.flatten().cast(pa.float64())
            offsets = column.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            size = np.diff(offsets)
            bad = ~np.isfinite(values := flat.to_numpy(zero_copy_only=False)) | (np.abs(values) > float(1 << 43))
            bad_before = np.concatenate(([0], np.cumsum(bad)))
            keep = np.flatnonzero((np.diff(bad_before[offsets]) == 0) & (size > 0))
            x = np.floor(SCALE * np.where(bad, 0, values)).astype(np.int64) + OFFSET
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep)), pa.array(size[keep].astype(np.int32)),
                pa.array([x[offsets[i]:offsets[i + 1]].tobytes() for i in keep], pa.binary())], ["id", "dim", "x"])

    usable = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull())
    return small_batches(usable).mapInArrow(batches, schema)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(-1, dim)


class Rows:
    """The distributed matrix: passes over its rows, and the exact moments that centre it."""

    def __init__(self, table: DataFrame, dim: int):
        self.table, self.dim = table, dim
        low = (1 << 24) - 1
        # sums in two halves of the numbers, so that no 64-bit sum overflows
        parts = self._gather(lambda x: np.concatenate(([len(x)], (x >> 24).sum(0), (x & low).sum(0))), np.int64)
        totals = [sum(column) for column in zip(*(p.tolist() for p in parts))] or [0] * (2 * dim + 1)
        self.n, high, rest = totals[0], totals[1:dim + 1], totals[dim + 1:]
        self.sums = [(h << 24) + r for h, r in zip(high, rest, strict=True)]
        self.floor = np.array([s // max(1, self.n) for s in self.sums], dtype=np.int64)
        self.rest = [s % max(1, self.n) for s in self.sums]
        self.fraction = np.array([r / max(1, self.n) for r in self.rest])

    def _gather(self, function, kind=np.float64) -> list[np.ndarray]:
        """``function`` of the rows of each batch, summed by task and brought to the driver."""
        dim = self.dim

        def batches(it):
            total = None
            for batch in it:
                if len(batch):
                    part = function(_matrix(batch.column(0), dim))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], ["part"])

        found = small_batches(self.table.select("x").coalesce(PARTS)).mapInArrow(batches, "part binary").collect()
        return [np.frombuffer(r["part"], dtype=kind) for r in found]

    def centred(self):
        floor, fraction = self.floor, self.fraction
        return lambda x: (x - floor) - fraction

    def sum_of(self, function) -> np.ndarray:
        """The sum over all rows of ``function`` of the centred rows (a flat array)."""
        centre = self.centred()
        parts = self._gather(lambda x: function(centre(x)))
        return np.sum(np.array(sorted(map(tuple, parts))), axis=0)

    def products(self, w: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """U'p, p'p and X'p of p = X w, where U = X ws."""
        def part(x):
            p = x @ w
            return np.concatenate(((x @ ws).T @ p, [p @ p], x.T @ p))

        k = ws.shape[1]
        got = self.sum_of(part)
        return got[:k], float(got[k]), got[k + 1:]


def bidiagonalise(rows: Rows, wanted: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(deviations, components): the ``wanted`` largest singular values of the centred rows, and their
    right singular vectors as columns."""
    dim = rows.dim
    rng = np.random.default_rng(seed)
    vs, ws = np.zeros((dim, 0)), np.zeros((dim, 0))  # v_j, and w_j with u_j = X w_j
    alphas: list[float] = []
    betas: list[float] = []
    v = _fresh(rng, vs)
    for step in range(dim):
        vs = np.column_stack((vs, v))
        # X v without its part along u_(j-1), then without what is left along any earlier u
        w = v - betas[-1] * ws[:, -1] if step else v.copy()
        w = w - ws @ rows.products(w, ws)[0]
        along, square, back = rows.products(w, ws)
        w = w - ws @ along  # of the size of rounding errors
        alpha = max(0.0, square - float(along @ along)) ** 0.5
        if alpha <= dim * _EPS * max([*alphas, *betas, alpha]):  # no variance is left outside the vectors found
            alphas.append(0.0)
            break
        ws = np.column_stack((ws, w / alpha))
        alphas.append(alpha)
        # X' u without all earlier v; the products with earlier u do not matter there
        q = back / alpha
        for _ in range(2):
            q = q - vs @ (vs.T @ q)
        beta = float(np.linalg.norm(q))
        left, values, right = np.linalg.svd(_bidiagonal(alphas, betas))
        near = min(wanted, len(values))
        if step + 1 == dim or len(values) > wanted and beta * np.abs(left[-1, :near]).max() <= 0.1 * _EPS * values[0]:
            break
        if beta <= dim * _EPS * values[0]:  # the space is closed; go on in the rest of it
            beta, q = 0.0, _fresh(rng, vs)
        betas.append(beta)
        v = q / np.linalg.norm(q)
    left, values, right = np.linalg.svd(_bidiagonal(alphas, betas[:len(alphas) - 1]))
    return values[:wanted], (vs[:, :len(alphas)] @ right.T)[:, :wanted]


def _fresh(rng: np.random.Generator, vs: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the columns of ``vs``."""
    v = rng.standard_normal(len(vs))
    for _ in range(2):
        v = v - vs @ (vs.T @ v)
        v /= np.linalg.norm(v)
    return v


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    """U'XV: alphas on the diagonal, betas above it."""
    return np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1)


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every usable vector and component.

    ``component`` counts from 1 by falling variance; ``whitened`` is the centred vector on that axis over the
    axis's standard deviation, ``explained`` the axis's share of all variance, ``deviation`` the exact squared
    distance of n times the vector from the sum of all, and ``identity_error`` the largest absolute entry of
    the covariance of ``whitened`` minus the identity, taken over all rows.
    """
    found = stored(whole_numbers(vectors, id_col, vector_col), "whole-vectors")
    common = found.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = common["dim"] if common else 1
    table = found.where(F.col("dim") == dim)
    rows = Rows(table, dim)
    fields = [T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("component", T.IntegerType()),
              T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
              T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())]
    schema = T.StructType(fields)
    if not rows.n:
        return vectors.sparkSession.createDataFrame([], schema)
    values, axes = bidiagonalise(rows, min(components, dim))
    kept = values > max(rows.n, dim) * _EPS * max(values[0], np.abs(rows.floor).max() * _EPS)
    axes = axes[:, kept] / (values[kept] / rows.n ** 0.5)
    trace = float(rows.sum_of(lambda x: np.array([np.einsum("ij,ij", x, x)]))[0])
    explained = values[kept] ** 2 / trace if trace else values[kept]
    k = axes.shape[1]
    error = 0.0
    if k:
        moments = rows.sum_of(lambda x: np.concatenate(((y := x @ axes).sum(0), (y.T @ y).ravel()))) / rows.n
        covariance = moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k])
        error = float(np.abs(covariance - np.eye(k)).max())
    n, centre, floor, rest = rows.n, rows.centred(), rows.floor, rows.rest

    def batches(it):
        for batch in it:
            x = _matrix(batch.column(1), dim)
            white = centre(x) @ axes
            distance = [_deviation(r, n, rest) for r in x - floor]
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), n, dtype=np.int64)), pa.array(distance, pa.int64()).take(at), pa.array(white.ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))], schema.fieldNames())

    return small_batches(table.select("id", "x")).mapInArrow(batches, schema)


def _deviation(row: np.ndarray, n: int, rest: list[int]) -> int | None:
    """The sum of (n * entry - rest)^2, exactly; None if a long can't hold it."""
    if n * (int(np.abs(row).max()) + 1) < 1 << 28 and len(row) < 1 << 6:
        y = n * row - np.array(rest, dtype=np.int64)
        return int(y @ y)
    total = sum((n * x - r) ** 2 for x, r in zip(row.tolist(), rest, strict=True))
    return total if total < 1 << 63 else None
