"""Whitening of embeddings by their leading principal components, found without a covariance matrix.

Entries become whole numbers on a grid of 1/64, so counts, sums and deviations are exact. The fit
list is each distinct vector once. LOBPCG works on a block of directions: one pass over the centred
rows gives the covariance's products with the iterate, its residuals and the previous directions;
Rayleigh-Ritz in their span gives the next iterate. Only blocks of (dimension x directions) numbers
reach the driver. Steps end when the residuals are certified as those of double precision.

Cases: vectors that are null, hold null or non-finite entries, have entries beyond 2^52 / 64 (they
have no exact place on the grid) or another length than the commonest one (ties: the longer) are
dropped. Repeated vectors count once in the fit and are all told. Components whose variance is not
above rounding (constant directions, fewer distinct vectors than directions) are not told, so an empty
table, empty vectors or one distinct vector give no rows. A null vec_id is kept. Deviations beyond a
long fail rather than wrap. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, tidy

SCALE, SHIFT = 64, 1_000_000
EXACT = float(1 << 52)


@dataclass(frozen=True)
class Whitening:
    components: int = 16
    #: Directions iterated beside the components: the block's last ones come to rest last.
    guard: int = 8
    #: Residual norms, over the largest eigenvalue, that count as certified.
    tolerance: float = 1e-14
    #: Norms that will do where rounding stops them from falling further.
    enough: float = 1e-11
    max_steps: int = 500


@dataclass(frozen=True)
class Fitted:
    n: int
    sums: np.ndarray  # by dimension, whole numbers
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit columns
    trace: float
    residual: float
    steps: int
    identity_error: float


def on_grid(vector: Column) -> Column:
    """Whole numbers of a vector's entries; null if any entry is null, not finite or too large."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    fits = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < EXACT), F.lit(False)))
    return F.when(fits, F.transform(scaled, lambda x: x.cast("long") + SHIFT))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def gridded(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x of the rows whose vector is whole and has the commonest length."""
    all_ = rows.select(F.col(f"`{key}`").alias("key"), on_grid(F.col(f"`{vector}`")).alias("x")).filter("x is not null")
    # The lengths that occur are few; the commonest is one row.
    length = all_.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).select("dim")
    return all_.join(F.broadcast(length), F.size("x") == F.col("dim")).filter("dim > 0").select("key", "x")


def _summed(table: DataFrame, cells: Callable[[np.ndarray], np.ndarray], dim: int, kind: str) -> dict[int, float]:
    """Sums over all rows of `cells(x)`, an array of bounded size for a batch of vectors; one array a task is shuffled."""
    arrow = pa.float64() if kind == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                got = cells(_matrix(batch.column(0), dim))
                total = got if total is None else total + got
        if total is not None:
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat, arrow)], names=["cell", "value"])

    rows = table.select("x").mapInArrow(tidy(run), f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    return {r["cell"]: r["value"] for r in rows}


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _independent(base: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """Orthonormal columns for the part of `block` outside the span of `base`; columns of rounding alone go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        if base is not None:
            block = block - base @ (base.T @ block)
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, rule: Whitening) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(eigenvalues, unit eigenvectors, largest residual over the largest eigenvalue, steps) of the leading components."""
    width = min(dim, rule.components + rule.guard)
    told = min(dim, rule.components)
    x = _independent(None, np.random.default_rng(7).standard_normal((dim, width)))
    r = p = np.zeros((dim, 0))
    best, still = np.inf, 0
    for step in range(1, rule.max_steps + 1):
        q = x
        for block in (r, p):
            q = np.hstack([q, _independent(q, block)])[:, :dim]
        w = product(q)
        inner = q.T @ w
        values, c = np.linalg.eigh((inner + inner.T) / 2)
        values, c = values[::-1][:width], c[:, ::-1][:, :width]
        new, image = q @ c, w @ c
        r = image - new * values
        top = max(float(values[0]), 0.0)
        worst = float(np.linalg.norm(r[:, :told], axis=0).max()) / top if top > 0 else 0.0
        p = new - x @ (x.T @ new)
        x = new
        still = 0 if worst < best / 2 else still + 1
        best = min(best, worst)
        if worst <= rule.tolerance or (worst <= rule.enough and still >= 2):
            return values[:told], x[:, :told], worst, step
    raise ArithmeticError(f"residuals of {best:.1e} after {rule.max_steps} steps are not certified")


def fit(vectors: DataFrame, rule: Whitening = Whitening()) -> Fitted | None:
    """Components of the distinct x of `vectors`; None if there are no rows."""
    scratch = Scratch()
    table = scratch.stored(vectors.select("x").dropDuplicates(["x"]), "vectors")
    first = table.select(F.size("x").alias("dim")).head()
    if first is None:
        scratch.clear()
        return None
    dim = first["dim"]
    sums_of = lambda x: np.append(x.sum(axis=0), len(x))
    cells = _summed(table, sums_of, dim, "long")
    n, sums = cells[dim], np.array([cells[k] for k in range(dim)], dtype=np.int64)

    def product(q: np.ndarray) -> np.ndarray:
        def cells(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        got = _summed(table, cells, dim, "double")
        return np.array([got[k] for k in range(dim * q.shape[1])]).reshape(dim, -1) / n

    trace = _summed(table, lambda x: np.array([(_centred(x, n, sums) ** 2).sum()]), dim, "double")[0] / n
    values, found, residual, steps = lobpcg(product, dim, rule)
    good = values > max(trace, 0.0) * 1e-12
    values, found = values[good], found[:, good]
    error = 0.0
    if len(values):
        scaled = found / np.sqrt(values)

        def moments(x: np.ndarray) -> np.ndarray:
            w = _centred(x, n, sums) @ scaled
            return np.vstack([w.T @ w, w.sum(axis=0)])

        got = _summed(table, moments, dim, "double")
        m = np.array([got[k] for k in range((len(values) + 1) * len(values))]).reshape(-1, len(values)) / n
        error = float(np.abs(m[:-1] - np.outer(m[-1], m[-1]) - np.eye(len(values))).max())
    scratch.clear()
    return Fitted(n, sums, values, found, trace, residual, steps, error)


def whiten(vectors: DataFrame, fitted: Fitted) -> DataFrame:
    """key, deviation, whitened (array, by component) for each row of `vectors` (key, x)."""
    n, sums, scaled = fitted.n, fitted.sums, fitted.vectors / np.sqrt(fitted.values)
    dim, width = scaled.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            far = n * x - sums
            if len(far) and float((far.astype(np.float64) ** 2).sum(axis=1).max()) >= 2.0**63:
                raise OverflowError("a deviation does not fit a long")
            white = (far / n) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * width + 1, width), pa.int32()), pa.array(white.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((far * far).sum(axis=1), pa.int64()), lists], names=["key", "deviation", "whitened"])

    kind = vectors.schema["key"].dataType.simpleString()
    return vectors.select("key", "x").mapInArrow(tidy(run), f"key {kind}, deviation long, whitened array<double>")


def whitened_components(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", rule: Whitening = Whitening()) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: one row for each whole vector and component."""
    vectors = gridded(rows, key, vector)
    fitted = fit(vectors, rule)
    if fitted is None or not len(fitted.values):
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values])
    told = whiten(vectors, fitted).select("key", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return told.select(
        F.col("key").alias(key),
        (F.col("k") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )
