"""Whitening of vectors with eigenvectors refined in higher precision (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cathodyne.llm.common import keep

#: Steps of a vector's unit, and what is added so that ordinary entries are positive.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this in steps are not taken, so that sums over rows stay exact.
MOST_STEPS = 1 << 40
#: Sums of squares beyond this do not fit a long.
MOST_SUM = 9.2e18
#: Refinement steps; each doubles the number of right digits.
STEPS = 12


def whole_steps(vec: Column) -> Column:
    """A vector's entries as longs, floor(64 c) + 1000000; null where the vector or an entry is null, non-finite or beyond ``MOST_STEPS``."""
    steps = F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE))
    taken = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < float(MOST_STEPS)))
    return F.when(vec.isNotNull() & taken, F.transform(steps, lambda s: s + SHIFT))


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: number and sums of its vectors, and components by falling eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # a column each
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.components / np.sqrt(self.values)


def refine(a: np.ndarray, vectors: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of symmetric ``a`` from approximate ``vectors``, by Ogita and Aishima's iteration.

    A step takes four products in extended precision: R = I - X'X and S = X'AX give a correction E of
    X that is right to second order where eigenvalues are apart. Those too close to be told apart at the
    step's accuracy make clusters; there E only restores orthogonality, and a cluster's vectors are then
    turned by the eigenvectors of its own small problem, shifted by its mean value so that its differences
    keep their digits.
    """
    wide = a.astype(np.longdouble)
    x = vectors.astype(np.longdouble)
    n, eps = len(a), np.finfo(np.float64).eps
    before = np.inf
    for _ in range(steps):
        r = np.eye(n, dtype=np.longdouble) - x.T @ x
        s = x.T @ (wide @ x)
        values = s.diagonal() / (1 - r.diagonal())
        off = s - np.diag(values)
        scale = np.abs(values).max(initial=0)
        close = 2 * (np.linalg.norm(off.astype(float)) + float(scale) * np.linalg.norm(r.astype(float)))
        close = max(close, float(scale) * np.sqrt(eps))  # a smaller gap would magnify rounding in its entry of E
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        size = float(np.abs(e).max(initial=0))
        clusters = _clusters(values.astype(float), close)
        for cluster in clusters:
            x[:, cluster] = _turned(wide, x[:, cluster])
        if size < eps / 8 or (size >= before and size < 1e-12):
            break
        before = size
    values = (x * (wide @ x)).sum(0) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), (x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))).astype(float)


def _clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Positions of the values that lie within ``close`` of a neighbour, by chains of two or more."""
    order = np.argsort(values, kind="stable")
    chains = np.split(order, np.flatnonzero(np.diff(values[order]) > close) + 1)
    return [c for c in chains if len(c) > 1]


def _turned(wide: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A cluster's vectors made orthonormal and turned to the eigenvectors of ``a`` within their span."""
    for _ in range(2):
        for k in range(x.shape[1]):
            x[:, k] -= x[:, :k] @ (x[:, :k].T @ x[:, k])
            x[:, k] /= np.sqrt((x[:, k] ** 2).sum())
    mean = np.trace(x.T @ (wide @ x)) / x.shape[1]
    small = x.T @ (wide @ x - mean * x)
    small = ((small + small.T) / 2).astype(float)
    return x @ np.linalg.eigh(small)[1].astype(np.longdouble)


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors of symmetric ``a``: single precision first, refined to double precision."""
    size = float(np.abs(a).max(initial=0))
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    rough = np.linalg.eigh((a / size).astype(np.float32))[1]
    values, vectors = refine(a / size, rough)
    return values * size, vectors


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, dim)


def _totals(vectors: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """``of`` every batch of rows, ``size`` numbers each, summed over all of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + of(_matrix(batch, dim))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "total"])

    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    rows = vectors.select("x").mapInArrow(partial, f"at int, total {kind}")
    for r in rows.groupBy("at").agg(F.sum("total").alias("total")).collect():  # a row per number, whatever the rows
        out[r.at] = r.total
    return out


def fit(vectors: DataFrame, dim: int, components: int) -> Whitening | None:
    """Components of the rows ``x`` of ``vectors``, all of length ``dim``; None for an empty table.

    Two passes: sums, then products of what is left when the nearest whole mean is taken off, which are
    whole numbers and so add up exactly, in any order, up to 2^53; the rest of the mean is taken off at
    the end. A task returns dim x dim sums, and the driver holds that many numbers whatever the rows.
    Components whose eigenvalue is lost in rounding are left out.
    """
    if not (n := vectors.count()):
        return None
    sums = _totals(vectors, dim, lambda x: x.sum(0), dim, "long")
    middle = (2 * sums + n) // (2 * n)
    rest = (sums - n * middle).astype(np.float64)

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - middle).astype(np.float64)
        return (y.T @ y).ravel()

    square = _totals(vectors, dim, products, dim * dim, "double").reshape(dim, dim)
    cov = (square - np.outer(rest, rest) / n) / n
    cov = (cov + cov.T) / 2
    values, directions = eigenvectors(cov)
    real = values > values.max(initial=0) * dim * np.finfo(np.float64).eps * 8
    count = min(components, int(real.sum()))
    return Whitening(n, sums, directions[:, :count], values[:count], float(np.trace(cov)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry, by size, of the whitened rows' covariance less the identity."""
    dim, count = model.components.shape

    def products(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.append((w.T @ w).ravel(), w.sum(0))

    total = _totals(vectors, dim, products, count * count + count, "double")
    mean = total[count * count :] / model.n
    cov = total[: count * count].reshape(count, count) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(count)).max(initial=0))


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error), one per row and component.

    Entries become whole steps of 1/64. Components are unit eigenvectors of the covariance over the
    different step vectors, each once, numbered from 1 by falling eigenvalue: single-precision
    eigenvectors of the distributed covariance, refined to double precision by matrix products in
    extended precision, with sub-solves for clusters of eigenvalues. ``deviation`` is the exact sum of
    (n x - S)^2, null beyond the range of a long. ``whitened`` is the centred row on the component over the
    root of its eigenvalue, ``explained`` the eigenvalue's share of the trace, and ``identity_error``
    is measured over the different vectors in a pass of its own.

    Rows whose vector is null, or holds null or non-finite entries or some of 2^34 or more, are left out. Vectors of
    each length are whitened by themselves; empty ones have no components. There are as many components
    as eigenvalues stand out of rounding: none where all vectors are equal. Null ids keep their rows,
    repeated ids and rows too. An empty table gives an empty one. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole_steps(F.col(vec_col)).alias("x")).where("x is not null and size(x) > 0")
    id_type = rows.schema["vec_id"].dataType.simpleString()
    different = keep(rows.select("x").distinct(), "whitening")
    out = None
    for dim in sorted(r.dim for r in different.select(F.size("x").alias("dim")).distinct().collect()):  # a row per length
        own = different.where(F.size("x") == dim)
        model = fit(own, dim, components)
        error = identity_error(own, model) if model.components.shape[1] else 0.0
        part = _applied(rows.where(F.size("x") == dim), model, error, id_type)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], _schema(id_type))
    return out.withColumnRenamed("vec_id", id_col)


def _schema(id_type: str) -> str:
    return f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _applied(rows: DataFrame, model: Whitening, error: float, id_type: str) -> DataFrame:
    dim, count = model.components.shape

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            off = x * model.n - model.sums
            deviation = pa.array((off * off).sum(1), mask=(off.astype(np.float64) ** 2).sum(1) >= MOST_SUM)
            each = np.repeat(np.arange(len(x)), count)
            columns = {
                "vec_id": batch.column("vec_id").take(pa.array(each)),
                "component": np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)),
                "n": np.full(len(each), model.n, np.int64),
                "deviation": deviation.take(pa.array(each)),
                "whitened": model.project(x).ravel(),
                "explained": np.tile(model.values / model.trace, len(x)),
                "identity_error": np.full(len(each), error),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(apply, _schema(id_type)) if count else rows.sparkSession.createDataFrame([], _schema(id_type))
