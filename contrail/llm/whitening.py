"""Operator 12: whitening of embeddings by cyclic Jacobi rotations.

Each entry c becomes the whole number ``floor(SCALE * c) + SHIFT``. The list of distinct vectors of whole numbers is the fit list; tasks sum it, then sum
the products of its centred vectors, and Spark adds up the partial sums by matrix entry. The driver gets that one matrix, as wide as a
vector, and applies Jacobi rotations in rounds that pair every two dimensions once a sweep, until no entry off the diagonal matters beside its
two diagonal ones; that test is relative, so small eigenvalues keep their digits. The components, sorted by falling eigenvalue and divided by its square root, are the whitening
matrix that every task applies; its size is that of ``components`` vectors.

Rows are dropped whose vector is null, or holds a null, NaN, infinite entry or one too large for a long. Vectors of another length than the commonest
(the longest of equally common ones) are dropped as well. A component is left out where its eigenvalue is zero to double
precision (at most ``d * 2 ** -52`` of the largest): there is nothing to divide by. So one distinct vector, or none, gives no rows, and an empty table none.
Repeated rows give equal rows each; a null vec_id stays. ``deviation`` is null where it is beyond a long. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, stored

SCALE, SHIFT = 64, 1_000_000
#: Entries of whole numbers stay below this, so that the difference of two is a long.
LARGEST = float(1 << 61)
COMPONENTS = 16
SWEEPS = 60


def whole(vector: Column) -> Column:
    """The vector in whole numbers; null where an entry has none."""
    sound = vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < LARGEST, F.lit(False)))
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as an array of whole numbers."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def jacobi(v: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    A sweep rotates every pair of dimensions once, in rounds of disjoint pairs; it ends when no entry off the diagonal is above
    2 ** -53 of the geometric mean of its diagonal entries, nor above the smallest double.
    """
    a = np.array(v, dtype=np.float64)
    n = len(a)
    u = np.eye(n)
    ring = np.arange(n + n % 2)  # an odd number gets a place that rests
    for _ in range(sweeps):
        turned = False
        for _ in range(max(0, len(ring) - 1)):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < n], q[q < n]
            off, low, high = a[p, q], a[p, p], a[q, q]
            some = (np.abs(off) > 2.0**-53 * np.sqrt(np.abs(low)) * np.sqrt(np.abs(high))) & (np.abs(off) > np.finfo(float).tiny)
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            if not some.any():
                continue
            turned = True
            p, q, off, low, high = p[some], q[some], off[some], low[some], high[some]
            with np.errstate(over="ignore"):
                half = (high - low) / (2 * off)  # cotangent of the double angle
                t = np.where(half < 0, -1.0, 1.0) / (np.abs(half) + np.hypot(1, half))
            c = 1 / np.hypot(1, t)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p], a[:, q]
            a[:, p], a[:, q] = cols_p * c - cols_q * s, cols_p * s + cols_q * c
            a[p, p], a[q, q] = low - t * off, high + t * off
            a[p, q] = a[q, p] = 0.0
            u_p, u_q = u[:, p], u[:, q]
            u[:, p], u[:, q] = u_p * c - u_q * s, u_p * s + u_q * c
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], u[:, order]


def _partial(df: DataFrame, figures: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], kind: str) -> dict[int, float]:
    """Sums over all rows of x: each task adds up figures (places, values) of its batches, Spark those of the tasks by place.

    There are as many places as the figures have, whatever the number of rows and tasks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                places, values = figures(matrix(batch.column(0)))
                total = values if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(total)], names=["place", "v"])

    summed = in_arrow(df.select("x"), run, f"place long, v {kind}").groupBy("place")
    total = F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v"))
    return {r.place: r.v for r in summed.agg(total.alias("v")).collect()}


def _products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangle of the products of centred rows, then their sums."""
    d = y.shape[1]
    values = np.concatenate([(y.T @ y)[np.triu_indices(d)], y.sum(0)])
    return np.arange(len(values)), values


def _covariance(sums: dict[int, float], d: int, n: int) -> np.ndarray:
    """From _products over n rows; what the rounded centre left is taken off."""
    values = np.array([sums[k] for k in range(len(sums))])
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = values[:-d]
    rest = values[-d:] / n
    return (out + np.triu(out, 1).T) / n - np.outer(rest, rest)


def _exact_squares(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2 for each row, in whole numbers of any size; null beyond a long."""
    middle = [s // n for s in sums]  # n * x - S = n * (x - middle) - rest: small numbers for rows near the middle
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    room = 1 << 62
    # the squares of all dimensions fit a long, or Python's whole numbers take over
    span = int(max(np.abs(x.astype(np.float64) - np.array(middle, np.float64)).max(initial=0.0), 0.0)) + 2
    if (n * (span + 1)) ** 2 * x.shape[1] < room:
        y = n * (x - np.array(middle, np.int64)) - np.array(rest, np.int64)
        return (y * y).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


class Whitening:
    """What was fitted: n, exact sums S, the covariance's eigenvalues, the whitening matrix and its check."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int) -> None:
        self.n, self.sums = n, sums
        values, vectors = jacobi(covariance)
        sound = values > max(values.max(initial=0.0), 0.0) * len(values) * 2.0**-52
        k = min(components, int(sound.sum()))
        self.explained = values[:k] / np.trace(covariance) if k else np.zeros(0)
        self.w = vectors[:, :k] / np.sqrt(values[:k])
        self.centre = [(s // n, (s % n) / n) for s in sums]
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part of the centre goes off first, without rounding."""
        whole_part, rest = zip(*self.centre, strict=True)
        return (x - np.array(whole_part, np.int64)).astype(np.float64) - np.array(rest)


def prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): rows with a sound vector of the commonest length."""
    rows = df.select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")
    sizes = rows.groupBy(F.size("x").alias("d")).count().filter("d > 0")
    common = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == F.lit(common.d if common else 0)).filter(F.size("x") > 0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of rows (x); None without rows."""
    distinct = stored(rows.select("x").distinct(), "fit")
    sums = _partial(distinct, _whole_sums, "long")
    if not sums:
        return None
    d = len(sums) // 2
    n, totals = int(sums[2 * d]), [(int(sums[k]) << 32) + int(sums[d + k]) for k in range(d)]
    empty = Whitening(n, totals, np.zeros((d, d)), 0)
    covariance = _covariance(_partial(distinct, lambda x: _products(empty.centred(x)), "double"), d, n)
    made = Whitening(n, totals, covariance, components)
    if k := made.w.shape[1]:
        white = _covariance(_partial(distinct, lambda x: _products(made.centred(x) @ made.w), "double"), k, n)
        made.identity_error = float(np.abs(white - np.eye(k)).max())
    return made


def _whole_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by dimension of the upper and of the lower 32 bits, which no batch brings beyond a long, and the number of rows."""
    values = np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), [len(x)]])
    return np.arange(len(values)), values


def transform(rows: DataFrame, made: Whitening, id_kind: str) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    k = made.w.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            white = made.centred(x) @ made.w
            squares = _exact_squares(x, made.n, made.sums)
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), made.n)),
                pa.array(squares, pa.int64()).take(pa.array(each)),
                pa.array(white.ravel()),
                pa.array(np.tile(made.explained, len(x))),
                pa.array(np.full(len(each), made.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"vec_id {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return in_arrow(rows, run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each sound vector and component, up to ``components`` of them, numbered from 1 by falling eigenvalue."""
    rows, kind = prepared(df, id_col, vector_col), df.schema[id_col].dataType.simpleString()
    made = fit(rows, components)
    if made is None:
        made, rows = Whitening(1, [0], np.zeros((1, 1)), 0), rows.limit(0)
    return transform(rows, made, kind)
