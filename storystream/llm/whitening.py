"""Embedding whitening by QDWH spectral divide-and-conquer.

Vectors are put on a grid of integers, so that sums are exact. Tasks add up the
products of centred vectors; of all vectors, only the covariance, d x d numbers,
reaches the driver. There its eigenvectors come from polar decompositions alone
(Nakatsukasa and Higham 2013): the polar factor of a shifted covariance is the
difference of two spectral projectors, whose ranges are invariant subspaces, one
above the shift and one below; each is split again until one direction is left.
The d x k whitening matrix is broadcast, and rows are whitened where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.session import materialize

COMPONENTS = 32
#: A number c becomes floor(SCALE * c) + OFFSET
SCALE, OFFSET = 64, 1_000_000
#: Numbers of larger magnitude have no exact place on the grid, and their row is left out
LARGEST = 2.0**40
#: Rows of a batch that are multiplied at once, and partial sums that are added in one place
BLOCK_ROWS = 4096
FAN_IN = 64

_EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps.

    Singular values that are zero to working precision are left where they are.
    """
    n = len(a)
    size = np.linalg.norm(a)
    if size == 0:
        return np.zeros_like(a)
    x, low = a / size, _EPS
    for _ in range(20):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        nearer = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        nearer = (nearer + nearer.T) / 2
        moved = np.linalg.norm(nearer - x)
        x, low = nearer, min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if low > 1 - 10 * _EPS and moved < 10 * _EPS ** (1 / 3):
            break
    return x


def range_of(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis of a projector's range, its longest remaining columns first."""
    rest = projector.copy()
    basis = np.zeros((len(projector), rank))
    for k in range(rank):
        v = rest[:, np.argmax((rest**2).sum(axis=0))]
        for _ in range(2):
            v = v - basis[:, :k] @ (basis[:, :k].T @ v)
        basis[:, k] = v / np.linalg.norm(v)
        rest = rest - np.outer(basis[:, k], basis[:, k] @ rest)
    return basis


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift inside the spectrum; None if it is one point."""
    n = len(a)
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * _EPS * scale:
        return None
    best, least = None, np.inf
    # The mean lies inside the spectrum; the others serve if an eigenvalue lies on it
    for step in (0, 0.2, -0.2, 0.4, -0.4, 0.1, -0.1, 0.3, -0.3):
        u = polar(a - (middle + step * spread) * np.eye(n))
        rank = round((np.trace(u) + n) / 2)
        if not 0 < rank < n:
            continue
        above, below = range_of((np.eye(n) + u) / 2, rank), range_of((np.eye(n) - u) / 2, n - rank)
        left_over = np.linalg.norm(below.T @ a @ above)
        if left_over < least:
            best, least = (above, below), left_over
        if least <= 8 * n * _EPS * scale:
            break
    return best


def _divide(a: np.ndarray, scale: float) -> np.ndarray:
    halves = _split(a, scale) if len(a) > 1 else None
    if halves is None:
        return np.eye(len(a))
    return np.hstack([v @ _divide(v.T @ a @ v, scale) for v in halves])


def _refined(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One Newton step towards orthonormal eigenvectors (Ogita and Aishima 2018)."""
    off = np.eye(len(a)) - v.T @ v
    s = v.T @ a @ v
    values = np.diag(s) / (1 - np.diag(off))
    gap = values[None, :] - values[:, None]
    bound = 2 * (np.linalg.norm(s - np.diag(values)) + np.linalg.norm(a) * np.linalg.norm(off))
    apart = np.abs(gap) > bound
    step = np.where(apart, (s + values[None, :] * off) / np.where(apart, gap, 1), off / 2)
    return v + v @ step


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors, as columns, of a symmetric matrix."""
    if not len(a):
        return np.empty(0), np.empty((0, 0))
    v = _divide(a, np.linalg.norm(a))
    for _ in range(2):
        v = _refined(a, v)
        # A Newton-Schulz step takes off what rounding adds where eigenvalues lie close
        v = v @ (1.5 * np.eye(len(a)) - 0.5 * v.T @ v)
    values = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


@dataclass
class Whitening:
    """What whitening needs of the fit list."""

    n: int
    sums: list[int]  # of the grid values, by dimension
    values: np.ndarray  # variances of the components, falling
    explained: np.ndarray  # share of all variance
    matrix: np.ndarray  # d x k; columns of components without variance are not numbers
    identity_error: float | None  # largest entry of the whitened covariance minus the identity

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Grid values minus their mean, rounded once."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - sum)^2; None beyond 64 bits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n for s in self.sums], np.int64)
        apart = x - whole
        if not x.size:
            return [0] * len(x)
        if (int(np.abs(apart).max()) * self.n + self.n) ** 2 * x.shape[1] < 2**63:
            return ((self.n * apart - part) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - p) ** 2 for a, p in zip(row, part.tolist())) for row in apart.tolist()]
        return [e if e < 2**63 else None for e in exact]


def grid(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of grid values of a column of vectors without nulls."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def usable(table: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has numbers only, all of the commonest length (of equally common ones the shortest)."""
    fine = F.expr(
        f"size(`{column}`) > 0 AND forall(`{column}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < {LARGEST / SCALE!r}D)"
    )
    rows = table.where(F.coalesce(fine, F.lit(False)))
    size = F.size(column)
    common = rows.groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(size == (common["size"] if common else 0))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            yield part, grid(part.column(column), size)


def _added(vectors: DataFrame, size: int, add: Callable, merge: Callable, label: str):
    """Fold all rows: `add` a block of grid values to a state of arrays, `merge` two states; None without rows.

    States are added up FAN_IN at a time, so no task nor the driver sees those of all tasks.
    """

    def pack(states: list) -> pa.RecordBatch:
        data = [np.concatenate([np.asarray(a, np.float64).ravel() for a in s]).tobytes() for s in states]
        return pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["state"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for _, x in _blocks(batches, 0, size):
            state = add(state, x)
        if state is not None:
            yield pack([state])

    def join(table: pa.Table) -> pa.Table:
        state = None
        for one in sorted(table["state"].to_pylist()):
            state = merge(state, one)
        return pa.Table.from_batches([pack([state])])

    states = materialize(vectors.mapInArrow(read, "state binary").withColumn("part", F.spark_partition_id()), label)
    while states.count() > FAN_IN:
        lots = states.select("state", F.floor(F.col("part") / FAN_IN).alias("lot"))
        joined = lots.groupBy("lot").applyInArrow(join, "state binary")
        states = materialize(joined.withColumn("part", F.spark_partition_id()), label)
    state = None
    for row in sorted(bytes(r.state) for r in states.collect()):
        state = merge(state, row)
    return state


def _moments(width: int) -> tuple[Callable, Callable]:
    """Count, mean and centred products of rows of numbers, put together as by Chan, Golub and LeVeque."""

    def merge(state, other):
        if isinstance(other, bytes):
            flat = np.frombuffer(other, np.float64)
            other = (flat[0], flat[1 : 1 + width], flat[1 + width :].reshape(width, width))
        if state is None:
            return other
        (n, mean, products), (m, other_mean, other_products) = state, other
        apart = other_mean - mean
        return (
            n + m,
            mean + apart * (m / (n + m)),
            products + other_products + np.outer(apart, apart) * (n * m / (n + m)),
        )

    def add(state, rows):
        mean = rows.mean(axis=0)
        centred = rows - mean
        return merge(state, (float(len(rows)), mean, centred.T @ centred))

    return add, merge


def _sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows, and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for _, x in _blocks(batches, 0, size):
            total += x.sum(axis=0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array(total), pa.array([n] * size, pa.int64())],
                names=["dimension", "total", "n"],
            )

    parts = vectors.mapInArrow(run, "dimension int, total bigint, n bigint")
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    rows = sorted(parts.groupBy("dimension").agg(exact.alias("total"), F.sum("n").alias("n")).collect())
    return (rows[0].n, [int(r.total) for r in rows]) if rows else (0, [])


def fit(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of `usable`; None if there are none.

    Components are the eigenvectors of the grid values' covariance by falling
    variance. One whose variance is zero to working precision cannot be scaled
    and gives null.
    """
    rows = usable(table, column)
    first = rows.select(F.size(column).alias("size")).first()
    if first is None:
        return None
    size = first["size"]
    vectors = rows.select(F.col(column).cast("array<double>").alias("v"))
    n, sums = _sums(vectors, size)
    model = Whitening(n, sums, np.empty(0), np.empty(0), np.empty((size, 0)), None)

    def products(state, x):
        centred = model.centred(x)
        return merge_products(state, centred.T @ centred)

    def merge_products(state, other):
        if isinstance(other, bytes):
            other = np.frombuffer(other, np.float64).reshape(size, size)
        return other if state is None else state + other

    covariance = _added(vectors, size, products, merge_products, "products") / n
    values, v = spectrum((covariance + covariance.T) / 2)
    k = min(components, size)
    fine = values[:k] > max(0.0, size * _EPS * values[0])
    scaled = np.full((size, k), np.nan)
    scaled[:, fine] = v[:, :k][:, fine] / np.sqrt(values[:k][fine])
    trace = np.trace(covariance)
    model.values = values[:k]
    model.explained = values[:k] / trace if trace > 0 else np.full(k, np.nan)
    model.matrix = scaled

    if fine.any():
        add, merge = _moments(int(fine.sum()))
        count, _, products_of = _added(
            vectors, size, lambda state, x: add(state, model.whitened(x)[:, fine]), merge, "whitened-products"
        )
        model.identity_error = float(np.abs(products_of / count - np.eye(int(fine.sum()))).max())
    return model


def transform(table: DataFrame, model: Whitening, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """Rows (vec_id, deviation, whitened), one per row that has a usable vector of the model's length.

    `deviation` is the exact squared distance of n times the grid values from
    their sums, null beyond 64 bits; `whitened` an array of one double per
    component.
    """
    size = len(model.sums)
    shared = table.sparkSession.sparkContext.broadcast(model)
    fine = F.expr(
        f"size(`{column}`) = {size} AND forall(`{column}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < {LARGEST / SCALE!r}D)"
    )
    rows = table.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_column).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whitening: Whitening = shared.value
        for batch, x in _blocks(batches, 1, size):
            w = whitening.whitened(x)
            values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            offsets = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(whitening.deviation(x), pa.int64()), pa.ListArray.from_arrays(offsets, values)],
                names=["vec_id", "deviation", "whitened"],
            )

    return rows.mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one per usable vector and component.

    Left out are rows whose vector is null, empty, holds null or non-finite
    numbers or such of 2^40 / 64 and more, or is not of the commonest length;
    rows of null id stay, and repeated rows count and return as often as they are
    there. `whitened` and, where nothing varies at all, `explained` and
    `identity_error` are null for components without variance. Other columns are
    ignored; an empty table gives no rows.
    """
    schema = (
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    model = fit(table, components=components)
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    explained = F.array(*(F.lit(None if np.isnan(e) else float(e)).cast("double") for e in model.explained))
    return (
        transform(table, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(model.n).cast("bigint").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, F.col("at")).alias("explained"),
            F.lit(model.identity_error).cast("double").alias("identity_error"),
        )
    )
