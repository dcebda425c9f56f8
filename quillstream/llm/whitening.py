"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V is never formed. Each pass over the rows multiplies it with one narrow block of columns Q, as X'(XQ) on
centred rows. The part of the product that earlier blocks don't span is orthonormalized by QR and is the next block; a
Rayleigh-Ritz step over all blocks kept gives eigenvalues, vectors and, without another pass, their residuals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

COMPONENTS = 8
#: Columns of a block for each component, and blocks that are kept for Rayleigh-Ritz before all but the best two go.
WIDTH, KEPT = 2, 8
#: A component is certified when its residual |Vq - eq| is at most this times the largest eigenvalue.
TOLERANCE = 1e-13
MAX_PASSES = 500
#: A component whose eigenvalue is at most this times the largest is rounding, and left out.
RANK = 1e-12
#: Entries beyond this count as not finite: 1024 times them is no exact double.
LARGEST = 2.0**43


def _entries(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a whole vector, and their integer vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims)
    if not len(rows) or not dims:
        return rows[:0], np.zeros((0, dims), np.int64)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    whole = (np.isfinite(values) & (np.abs(values) <= LARGEST)).all(axis=1)
    return rows[whole], np.floor(1024 * values[whole]).astype(np.int64) + 100_000


@dataclass(frozen=True)
class Fit:
    """What all rows together say: n vectors, the sum of each dimension (exact), and the components as columns."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    residual: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, without cancellation: the whole part of S/n goes while x is an integer."""
        whole, rest = np.array([divmod(s, self.n) for s in self.sums], dtype=object).T
        return (x - whole.astype(np.int64)) - rest.astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (nx - S)^2 for each vector, exact; null where that is no long."""
        if not len(x):
            return []
        whole, rest = (np.array(a, dtype=object) for a in zip(*(divmod(s, self.n) for s in self.sums)))
        off = x - whole.astype(np.int64)
        if x.shape[1] * (self.n * (int(np.abs(off).max()) + 1)) ** 2 < 2**63:
            return ((self.n * off - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * off.astype(object) - rest) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact.tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _sums(vectors: DataFrame, dims: int, fold: Callable[[Iterator[np.ndarray]], np.ndarray], width: int) -> np.ndarray:
    """The sum over all tasks of fold(the task's batches of vectors), a matrix of dims rows; the tasks' rows are added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = fold(_entries(b.column(0), dims)[1] for b in batches)
        if part is not None:
            columns = [pa.array(np.arange(len(part)), pa.int32()), *(pa.array(np.ascontiguousarray(c), pa.float64()) for c in part.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", *(f"y{j}" for j in range(width))])

    schema = "i int, " + ", ".join(f"y{j} double" for j in range(width))
    rows = vectors.mapInArrow(run, schema).groupBy("i").agg(*(F.sum(f"y{j}").alias(f"y{j}") for j in range(width))).collect()
    return np.array([r[1:] for r in sorted(rows)], np.float64).reshape(-1, width)


def _totals(vectors: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """The number of whole vectors and the exact sums of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for b in batches:
            _, x = _entries(b.column(0), dims)
            safe = not len(x) or int(np.abs(x).max()) * len(x) < 2**62
            n, total = n + len(x), total + (x.sum(axis=0) if safe else x.astype(object).sum(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(dims)), "n": [n] * dims, "s": [str(s) for s in total]})

    found = vectors.mapInArrow(run, "i long, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = sorted(found.collect())
    return (rows[0]["n"], tuple(int(r["s"]) for r in rows)) if rows else (0, ())


def _outside(block: np.ndarray, basis: np.ndarray, floor: float) -> np.ndarray:
    """An orthonormal basis of what block adds to basis; columns whose rest is not above floor add nothing."""
    for _ in range(2):  # twice is enough
        block = block - basis @ (basis.T @ block)
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    left = left[:, size > floor]
    return np.linalg.qr(left - basis @ (basis.T @ left))[0]


def subspace(multiply: Callable[[np.ndarray], np.ndarray], dims: int, k: int, width: int, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(values, vectors, passes, residual) of the k largest eigenvalues of a symmetric matrix that is known by multiply alone.

    After kept blocks, the two blocks' worth of best Ritz vectors stay with their images, and blocks are added again. The
    basis of all dimensions, or one that no product leaves, ends the iteration too: its Ritz vectors are exact.
    """
    k, width = min(k, dims), min(width, dims)
    basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    block = np.linalg.qr(np.random.default_rng(12).standard_normal((dims, width)))[0]
    for passes in range(1, MAX_PASSES + 1):
        basis, images = np.hstack([basis, block]), np.hstack([images, multiply(block)])
        ritz = basis.T @ images
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        best, image = basis @ turn[:, : 2 * width], images @ turn[:, : 2 * width]
        off = image - best * values[: 2 * width]
        top = max(values[0], 0.0)
        residual = float(np.linalg.norm(off[:, :k], axis=0).max()) / top if top else 0.0
        if basis.shape[1] >= k and residual <= TOLERANCE or basis.shape[1] == dims:
            return values[:k], best[:, :k], passes, residual
        if basis.shape[1] >= kept * width:
            basis, images = np.linalg.qr(best)[0], image  # orthonormal already but for rounding
            basis *= np.sign(np.sum(basis * best, axis=0))
        room = min(width, dims - basis.shape[1])
        block = _outside(off[:, :width], basis, 1e-15 * top)[:, :room]
        if not block.shape[1]:
            if basis.shape[1] >= k:
                return values[:k], best[:, :k], passes, residual
            block = _outside(np.random.default_rng(passes).standard_normal((dims, room)), basis, 0.0)
    raise RuntimeError(f"after {MAX_PASSES} passes the residual is {residual:.2g} of the largest eigenvalue")


def fit(embeddings: DataFrame, column: str = "embedding", k: int = COMPONENTS, width: int | None = None) -> Fit | None:
    """The components of all whole vectors; None where no vector is left or none differs from another.

    Vectors have one length: those of another than the most frequent (of several, the longest) count as holding nothing.
    The driver holds matrices of dimensions x columns of the kept blocks; rows never pass it.
    """
    vectors = small_batches(embeddings).select(F.col(column).alias("v"))
    lengths = vectors.groupBy(F.size("v").alias("dims")).count().where("dims > 0").orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return None
    dims = lengths[0]["dims"]
    n, sums = _totals(vectors, dims)
    if not n:
        return None
    means = Fit(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, 0, 0.0)
    trace = []

    def multiply(block: np.ndarray) -> np.ndarray:
        def fold(batches: Iterator[np.ndarray]) -> np.ndarray | None:
            total = None
            for x in batches:
                if len(x):
                    c = means.centred(x)
                    part = np.hstack([c.T @ (c @ block), (c * c).sum(axis=0)[:, None]])
                    total = part if total is None else total + part
            return total

        found = _sums(vectors, dims, fold, block.shape[1] + 1) / n
        trace.append(float(found[:, -1].sum()))
        return found[:, :-1]

    values, found, passes, residual = subspace(multiply, dims, k, width or WIDTH * k)
    real = values > RANK * max(values[0], 0.0)
    if not real.any() or not trace[0]:
        return None
    found, values = found[:, real], values[real]
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    return Fit(n, sums, found, values, trace[0], passes, residual)


def identity_error(embeddings: DataFrame, model: Fit, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all vectors."""
    k, dims = len(model.values), len(model.sums)

    def fold(batches: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in batches:
            if len(x):
                w = model.whitened(x)
                part = np.hstack([w.T @ w, w.sum(axis=0)[:, None]])
                total = part if total is None else total + part
        return total

    found = _sums(small_batches(embeddings).select(F.col(column).alias("v")), dims, fold, k + 1) / model.n
    mean = found[:, -1]
    return float(np.abs(found[:, :-1] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(embeddings: DataFrame, column: str = "embedding", k: int = COMPONENTS, width: int | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of embeddings(vec_id, column, ...).

    One row for each vector and component. Rows whose vector is null, or holds a null, not finite or too large entry (beyond
    LARGEST), give none, nor do vectors of an odd length (see fit); of equal vectors and repeated rows each counts. A table
    without rows, or without two different vectors, has no components and gives no rows; fewer dimensions than k, or vectors
    in a flat, give as many components as there are. Where eigenvalues tie, any orthonormal vectors of their flat are
    components. Signs are such that a component's largest entry is positive. Other columns aren't read.

    The fit runs at once, in a few passes over the vector column; the result is one more pass, without a shuffle.
    """
    model = fit(embeddings, column, k, width)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error, dims, count = identity_error(embeddings, model, column), len(model.sums), len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _entries(b.column(1), dims)
            m = len(rows) * count
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(rows, count), pa.int64())), pa.array(np.tile(np.arange(1, count + 1), len(rows)), pa.int32()), pa.array([model.n] * m, pa.int64()),
                    pa.array([v for v in model.deviation(x) for _ in range(count)], pa.int64()), pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, len(rows))), pa.array([error] * m, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return small_batches(embeddings).select("vec_id", F.col(column).alias("v")).mapInArrow(run, schema)
