"""Whitening of embeddings by their leading principal components.

Entries become whole numbers, so that sums over rows are exact. Two passes give the mean and the centred covariance, a matrix of
``dimensions`` squared, whatever the number of rows. On the driver that matrix is reduced to a tridiagonal one by Householder reflections;
Sturm counts bisect for its leading eigenvalues; inverse iteration gives their vectors, orthogonalised again within clusters of
near eigenvalues and turned back by the reflections. Rows are then projected where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stable

SCALE, SHIFT = 1024.0, 100_000
LARGEST = float(1 << 50)  # of a scaled entry: sums of CHUNK rows then fit 64 bits
CHUNK = 4096
EPS = float(np.finfo(np.float64).eps)
TINY = float(np.finfo(np.float64).tiny)


@dataclass(frozen=True)
class Whitening:
    """``dimensions`` bounds the covariance on the driver (its square, in doubles); longer vectors are an error."""

    components: int = 8
    dimensions: int = 4096


def whiten(rows: DataFrame, whitening: Whitening = Whitening(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per kept vector and component, components from 1.

    An entry ``c`` becomes ``floor(1024 * c) + 100000``. Left out: null vectors, vectors with null or non-finite entries, or with an entry
    beyond 2**50 after scaling (no whole number of 64 bits would hold their sums), and vectors whose length is not the
    commonest one (of equally common lengths the longest; empty vectors never count). ``deviation`` is the exact sum of
    ``(n * x - S) ** 2``, null where 64 bits do not hold it. Components without variance (constant vectors, a single row, fewer
    dimensions than components) are not returned, so such tables may give no rows. Repeated rows count, and come back, as often as they occur;
    a null id is passed through; further columns are left out.
    """
    source = rows.select(rows[id_col].alias("vec_id"), rows[vector_col].cast("array<double>").alias("vector"))
    moments = stable(source.mapInArrow(_moments, "length int, at int, n long, total decimal(38,0)")
                     .groupBy("length", "at").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")))
    schema = f"vec_id {source.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = moments.filter("at = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    size, n = common["length"], common["n"]
    if size > whitening.dimensions:
        raise ValueError(f"vectors of {size} entries; Whitening.dimensions allows {whitening.dimensions}")
    total = [int(r["total"]) for r in moments.filter(F.col("length") == size).orderBy("at").collect()]  # one row per dimension
    mean = np.array([t // n for t in total]), np.array([t % n / n for t in total])
    cells = (source.mapInArrow(lambda b: _products(b, mean), "cell int, value double")
             .groupBy("cell").agg(F.sum("value").alias("value")).toArrow())  # one row per pair of dimensions
    covariance = np.zeros((size, size))
    covariance.flat[cells.column("cell").to_numpy()] = cells.column("value").to_numpy() / n
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    values, vectors = leading(covariance, whitening.components)
    trace = float(np.trace(covariance))
    real = values > size * EPS * max(trace, TINY)
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    if k == 0:
        return rows.sparkSession.createDataFrame([], schema)
    remainder = np.array([t % n for t in total])
    projection = vectors / np.sqrt(values)
    projected = stable(source.mapInArrow(lambda b: _project(b, mean, remainder, n, projection), "vec_id " + source.schema["vec_id"].dataType.simpleString() + ", deviation long, w array<double>"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = projected.select([F.col("w")[i].alias(f"w{i}") for i in range(k)]).agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    each = projected.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    return each.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       explained[F.col("_at")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def _whole(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Matrices of whole numbers, the rows of the batch they stand for, and the batch: one matrix for each length and ``CHUNK`` rows."""
    for batch in batches:
        column = batch.column("vector")
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False)  # a null entry becomes NaN
        first = np.cumsum(lengths) - lengths
        for length in np.unique(lengths[lengths > 0]) if size is None else [size]:
            at = np.flatnonzero(lengths == length)
            for low in range(0, len(at), CHUNK):
                own = at[low:low + CHUNK]
                x = np.floor(SCALE * values[first[own, None] + np.arange(length)])
                good = (np.abs(x) <= LARGEST).all(1)  # neither NaN nor an infinity is
                if good.any():
                    yield x[good].astype(np.int64) + SHIFT, own[good], batch


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    totals: dict[int, np.ndarray] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for size, n in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.full(size, n)),
                                              pa.array([Decimal(int(t)) for t in totals[size]], pa.decimal128(38, 0))], ["length", "at", "n", "total"])
        counts.clear()
        totals.clear()

    for x, _, _ in _whole(batches):
        size = x.shape[1]
        if size not in counts and len(counts) >= 64:
            yield from given()
        counts[size] = counts.get(size, 0) + len(x)
        totals[size] = totals.get(size, 0) + x.sum(0).astype(object)  # whole numbers without a bound
    yield from given()


def _products(batches: Iterator[pa.RecordBatch], mean: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums of products of centred entries over a task, upper triangle."""
    size = len(mean[0])
    total = None
    for x, _, _ in _whole(batches, size):
        centred = (x - mean[0]) - mean[1]
        total = centred.T @ centred + (0 if total is None else total)
    if total is not None:
        cell = np.flatnonzero(np.triu(np.ones((size, size), bool)))
        for low in range(0, len(cell), 1 << 16):
            own = cell[low:low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total.flat[own])], ["cell", "value"])


def _project(batches: Iterator[pa.RecordBatch], mean: tuple[np.ndarray, np.ndarray], remainder: np.ndarray, n: int, projection: np.ndarray) -> Iterator[pa.RecordBatch]:
    for x, own, batch in _whole(batches, len(mean[0])):
        away = x - mean[0]
        w = (away - mean[1]) @ projection
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(own)), pa.array(deviations(away, remainder, n), pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))], ["vec_id", "deviation", "w"])


def deviations(away: np.ndarray, remainder: np.ndarray, n: int) -> list[int | None]:
    """Exact sums of ``(n * away - remainder) ** 2`` by row, None beyond 64 bits."""
    about = ((away * float(n) - remainder) ** 2).sum(1)
    fits = about < 2.0 ** 61
    out = np.zeros(len(away), object)
    out[fits] = ((away[fits] * n - remainder) ** 2).sum(1)
    for row in np.flatnonzero(~fits):
        exact = sum((n * int(a) - int(r)) ** 2 for a, r in zip(away[row], remainder, strict=True))
        out[row] = exact if exact < 1 << 63 else None
    return out.tolist()


# ---- eigenvectors of a symmetric matrix ------------------------------------------------------------------------------

def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns; of each the entry of largest size is positive."""
    k = min(k, len(matrix))
    scale = float(np.abs(matrix).max(initial=0.0))
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(len(matrix), k)
    diagonal, beside, mirrors = tridiagonal(matrix / scale)
    values = bisect(diagonal, beside, k)
    vectors = inverse_iteration(diagonal, beside, values)
    for at, v in reversed(mirrors):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return values * scale, vectors


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal, and the Householder vectors with the row each starts at."""
    a = matrix.astype(np.float64, copy=True)
    n = len(a)
    beside, mirrors = np.zeros(max(n - 1, 0)), []
    for j in range(n - 1):
        x = a[j + 1:, j]
        if not x[1:].any():
            beside[j] = x[0]
            continue
        beside[j] = -np.copysign(np.linalg.norm(x), x[0])
        v = x.copy()
        v[0] -= beside[j]
        v /= np.linalg.norm(v)
        rest = a[j + 1:, j + 1:]
        p = rest @ v
        p -= (v @ p) * v
        rest -= 2 * (np.outer(v, p) + np.outer(p, v))
        mirrors.append((j + 1, v))
    return a.diagonal().copy(), beside, mirrors


def below(diagonal: np.ndarray, beside: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie under each ``x``: negative pivots of the shifted matrix."""
    least = EPS * max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0)) ** 2 * EPS + TINY
    q, count = np.ones(len(x)), np.zeros(len(x), np.int64)
    for d, e in zip(diagonal, np.append(0.0, beside), strict=True):
        q = d - x - e * e / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def bisect(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, to the last bit that Sturm counts decide."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(beside)]) + np.concatenate([np.abs(beside), [0.0]])
    bound = float((np.abs(diagonal) + reach).max()) * (1 + 4 * EPS) + TINY
    low, high = np.full(k, -bound), np.full(k, bound)
    wanted = n - 1 - np.arange(k)  # an eigenvalue has as many under it
    while True:
        middle = (low + high) / 2
        moving = (middle > low) & (middle < high) & (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)) + TINY)
        if not moving.any():
            return middle
        under = below(diagonal, beside, middle) > wanted
        high, low = np.where(moving & under, middle, high), np.where(moving & ~under, middle, low)


def inverse_iteration(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray, near: float = 1e-3, most: int = 12) -> np.ndarray:
    """Unit eigenvectors as columns. Eigenvalues closer than ``near`` of the matrix' size to the one before form a cluster, whose vectors are
    made orthogonal to each other in every step."""
    n, k = len(diagonal), len(values)
    norm = float(max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0)))
    out = np.zeros((n, k))
    rng = np.random.default_rng(1)
    start, shift = 0, np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > near * norm:
            start = j
        # equal eigenvalues are shifted apart by some rounding errors
        shift = min(values[j], shift - 10 * EPS * norm) if j > start else values[j]
        z = rng.uniform(-1, 1, n)
        factors = _factor(diagonal - shift, beside, EPS * norm)
        good = 0
        for _ in range(most):
            for _ in range(2):
                z -= out[:, start:j] @ (out[:, start:j].T @ z)
            z /= np.linalg.norm(z)
            z = _solve(factors, z)
            size = float(np.linalg.norm(z))
            z /= size
            good += size * norm * EPS * n > 0.01  # the residual is 1 / size
            if good > 2:
                break
        for _ in range(2):
            z -= out[:, start:j] @ (out[:, start:j].T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def _factor(diagonal: np.ndarray, beside: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Gaussian elimination with row exchanges of a symmetric tridiagonal matrix: three diagonals, multipliers, exchanges."""
    n = len(diagonal)
    d, u, uu = diagonal.copy(), np.append(beside, 0.0), np.zeros(n)
    factor, swapped = np.zeros(n), np.zeros(n, bool)
    for i in range(n - 1):
        lower, d1, u1 = beside[i], d[i + 1], u[i + 1]
        if abs(lower) > abs(d[i]):
            factor[i], swapped[i] = d[i] / lower, True
            d[i], u[i], uu[i], d[i + 1], u[i + 1] = lower, d1, u1, u[i] - factor[i] * d1, -factor[i] * u1
        else:
            factor[i] = lower / d[i] if d[i] else 0.0
            d[i + 1] = d1 - factor[i] * u[i]
    d[np.abs(d) < least] = least
    return d, u, uu, factor, swapped


def _solve(factors: tuple[np.ndarray, ...], b: np.ndarray) -> np.ndarray:
    d, u, uu, factor, swapped = factors
    z, n = b.copy(), len(b)
    for i in range(n - 1):
        if swapped[i]:
            z[i], z[i + 1] = z[i + 1], z[i]
        z[i + 1] -= factor[i] * z[i]
    for i in range(n - 1, -1, -1):
        z[i] -= (u[i] * z[i + 1] if i + 1 < n else 0.0) + (uu[i] * z[i + 2] if i + 2 < n else 0.0)
        z[i] /= d[i]
    return z
