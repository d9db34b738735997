"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

1. Vectors become whole numbers; each distinct one counts once. Sums are exact; the scatter is added up from tasks after a whole-number shift
   to within half a unit of the mean, so the products are whole numbers too and do not depend on the order of tasks. What is left of the mean is
   taken off at the end.
2. The covariance V is factored with pivoting: rows and columns permuted, V = L·Lᵀ with L lower triangular, until no pivot is left. That gives the
   rank, and a factor whose columns fall in size.
3. One-sided Jacobi rotates pairs of columns of L until all are orthogonal. V = (L·J)(L·J)ᵀ, so the squares of the rotated
   columns' norms are the eigenvalues and the normalised columns the components. Nothing is squared: small eigenvalues keep their digits.
4. Tasks project the rows.

The driver sees sums of one and two dimensions only. It works in double precision; pairs that do not share a column are rotated together.

Defined cases: a null vector, an empty one or one with null or non-finite entries takes no part; vectors of another length than most rows have (the longer one of equals)
take no part either; repeated rows and ids are projected each; components without variance (fewer distinct vectors than
dimensions, constant dimensions) are left out, so one distinct vector gives no rows; a ``deviation`` beyond 64 bits is null; entries are exact
while 64 times them is within 2⁵²; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
ROWS = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame, width: int, made: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows of what ``made`` gives for a block of vectors: added up per task, then per place of the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = made(_matrix(batch.column(0).slice(lo, ROWS)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    out = np.zeros(made(np.zeros((0, width), np.int64)).shape, np.int64 if kind == "long" else float)
    sums = rows.select("x").mapInArrow(run, f"place long, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
    flat = out.reshape(-1)
    for r in sums.collect():
        flat[r["place"]] = r["value"]
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with V = L·Lᵀ, a column per rank; lower triangular once the rows are put in the order of the pivots."""
    left, l, pivots = np.diag(v).astype(float), np.zeros((len(v), 0)), []
    limit = len(v) * np.finfo(float).eps * left.max(initial=0)
    while len(pivots) < len(v):
        pivot = int(left.argmax())
        if left[pivot] <= limit:
            break
        column = (v[:, pivot] - l @ l[pivot]) / np.sqrt(left[pivot])
        column[pivots] = 0.0
        l = np.column_stack((l, column))
        pivots.append(pivot)
        left = left - column ** 2
        left[pivots] = -np.inf
    return l


def one_sided_jacobi(l: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms (falling) and unit columns of L·J, where J is the rotation that makes the columns orthogonal."""
    a, n = l.astype(float).copy(), l.shape[1]
    if n:
        a = a[:, np.argsort(-(a ** 2).sum(axis=0), kind="stable")]
    seats = np.arange(n + n % 2)  # a round robin: every pair of columns meets once a sweep
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < n], q[q < n]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), scale, out=np.zeros_like(scale), where=scale > 0)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if worst <= 1e-15 * max(n, 1) ** 0.5:
            break
    norms = (a * a).sum(axis=0)
    order = np.argsort(-norms, kind="stable")
    norms, a = norms[order], a[:, order]
    kept = norms > 0
    return norms[kept], a[:, kept] / np.sqrt(norms[kept])


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, the whole-number vectors of the rows that take part."""
    v = F.col(column)
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(SCALE * c.cast("double")) + F.lit(SHIFT))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & finite).select(F.col("vec_id").cast("long"), x.alias("x"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    rows = written(whole_vectors(vectors, column), "whiten-rows")
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width = widths["width"] if widths else 1
    rows = rows.where(F.size("x") == width)
    fit = written(rows.select("x").distinct(), "whiten-fit")
    n = fit.count()
    sums = _summed(fit, width, lambda x: x.sum(axis=0), "long")
    shift = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64) if n else sums
    rest = np.array([(int(s) - n * int(c)) / n for s, c in zip(sums, shift)]) if n else np.zeros(width)

    def products(x: np.ndarray) -> np.ndarray:
        d = (x - shift).astype(float)
        return d.T @ d

    v = _summed(fit, width, products, "double") / max(n, 1) - np.outer(rest, rest)
    values, axes = one_sided_jacobi(pivoted_cholesky(v))
    values, axes = values[:components], axes[:, :components]
    trace = float(np.trace(v))

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - shift).astype(float) - rest) @ axes / np.sqrt(values)

    mean = _summed(fit, width, lambda x: projected(x).sum(axis=0), "double") / max(n, 1)

    def spread(x: np.ndarray) -> np.ndarray:
        w = projected(x) - mean
        return w.T @ w

    error = float(np.abs(_summed(fit, width, spread, "double") / max(n, 1) - np.eye(len(values))).max(initial=0))

    def deviations(x: np.ndarray) -> pa.Array:
        d = n * (x - shift) - (sums - n * shift)
        if np.abs(d).max(initial=0) < (2 ** 62 / width) ** 0.5:
            return pa.array((d * d).sum(axis=1))
        exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for lo in range(0, batch.num_rows if k else 0, ROWS):
                part = batch.slice(lo, ROWS)
                x = _matrix(part.column(1))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), deviations(x).take(each),
                    pa.array(projected(x).ravel()), pa.array(np.tile(values / trace, len(x))), pa.array(np.full(len(x) * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
