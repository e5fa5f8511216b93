"""Whitening of vectors by spectral divide and conquer.

The covariance is summed by Spark in exact whole numbers. Its eigenvectors come from polar
decompositions: the unitary polar factor of a shifted symmetric matrix is the sign of its
eigenvalues, so (factor + 1) / 2 projects on the eigenvectors above the shift. The matrix
is split on both projections and each part is split again until every part is a single
component. Polar factors are found by the dynamically weighted Halley iteration (QDWH),
which needs QR factorisations alone. The components are then sent to every task.

Vectors stay where they are: each task adds up its own, and a tree of sums of `FAN_IN`
joins the tasks' matrices, which are as large as the square of the dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.session import scratch_space, stored

# Partial sums that one task joins.
FAN_IN = 16
# Entries are whole numbers below this, so that doubles hold them exactly.
LARGEST = 1 << 52
_EPS = np.finfo(float).eps
_HALF = 26


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by the QDWH iteration.

    The weights follow a lower bound of the smallest singular value, which at first is
    taken as low as rounding allows; six rounds are then enough.
    """
    size = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(size)
    x, low = a / norm, _EPS
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        first = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        second = (first - 1) ** 2 / 4
        third = first + second - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(third) * x, np.eye(size)]))
        step = (first - second / third) / np.sqrt(third) * (q[:size] @ q[size:].T) + second / third * x
        moved = np.linalg.norm(step - x)
        x, low = step, min(low * (first + second * square) / (1 + third * square), 1.0)
        if moved < 1e-15 * np.sqrt(size) or (1 - low < 1e-15 and moved < np.cbrt(_EPS) / 100):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift, both non-empty."""
    size = len(a)
    diagonal = np.sort(np.diag(a))
    mean, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(size)) / np.sqrt(size)
    draw = np.random.default_rng(size)
    shifts = [float(np.median(diagonal)), float(mean), *(mean + spread * draw.uniform(-1, 1, 20))]
    best, error = None, np.inf
    for shift in shifts:
        sign = polar_factor(a - shift * np.eye(size))
        sign = (sign + sign.T) / 2
        above = int(round((np.trace(sign) + size) / 2))
        if not 0 < above < size:
            continue
        upper, lower = (np.eye(size) + sign) / 2, (np.eye(size) - sign) / 2
        start = np.hstack([upper @ draw.standard_normal((size, above)), lower @ draw.standard_normal((size, size - above))])
        basis, _ = np.linalg.qr(start)
        basis, _ = np.linalg.qr(np.hstack([upper @ basis[:, :above], lower @ basis[:, above:]]))
        high, low = basis[:, :above], basis[:, above:]
        # An eigenvalue next to the shift leaves the two sides joined.
        joined = np.linalg.norm(high.T @ a @ low)
        if joined < error:
            best, error = (high, low), joined
        if error <= 20 * size * _EPS * np.linalg.norm(a):
            break
    return best


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix.

    Parts whose eigenvalues agree to rounding are not split: any basis of them will do.
    """
    size, whole = len(a), np.linalg.norm(a)
    values, vectors = [], []
    open_parts = [np.eye(size)] if size else []
    while open_parts:
        basis = open_parts.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        off = np.linalg.norm(part - np.diag(np.diag(part)))
        split = None if len(part) == 1 or off <= 4 * _EPS * whole else _split(part)
        if split is None:
            values += np.diag(part).tolist()
            vectors += list(basis.T)
        else:
            open_parts += [basis @ side for side in split]
    order = sorted(range(size), key=lambda i: -values[i])
    return np.array([values[i] for i in order]), np.array([vectors[i] for i in order]).reshape(size, size).T


def _finite(vector: Column) -> Column:
    """Neither NULL nor empty, all entries finite and small enough for an exact whole number."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LARGEST >> 12))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, ok)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _summed(rows: DataFrame, own: Callable[[Iterator[np.ndarray]], dict[str, np.ndarray]], schema: str) -> dict[str, np.ndarray]:
    """`own` of every task's matrices, whose arrays are added up in a tree over the tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = own(_matrix(b.column(0)) for b in batches if b.num_rows)
        if sums:
            lane = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([lane, *(pa.array([v.ravel()]) for v in sums.values())], ["lane", *sums])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        names = table.column_names[1:]
        added = [np.sum([v.as_py() for v in table.column(n)], axis=0) for n in names]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([v]) for v in added)], ["lane", *names])

    level = stored(rows.mapInArrow(partial, schema), "sums")
    count = (level.agg(F.max("lane")).first()[0] or 0) + 1
    while True:
        lane = F.floor(F.col("lane") / FAN_IN).cast("bigint").alias("_lane")
        level, count = level.groupBy(lane).applyInArrow(add, schema), -(-count // FAN_IN)
        if count == 1:
            row = level.first()
            return {} if row is None else {n: np.array(row[n]) for n in row.asDict() if n != "lane"}


@dataclass
class Whitening:
    """What a table of vectors was fitted to; entries are whole numbers x.

    `sums` are the exact sums of x by dimension, `eigenvalues` those of the whole covariance,
    falling, `components` the first of its eigenvectors as columns.
    """

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    scale: float
    offset: int
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        trace = float(self.eigenvalues.sum())
        return self.eigenvalues / trace if trace > 0 else np.zeros(len(self.eigenvalues))

    def _centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole numbers next to the means, and what is missing to the means."""
        near = [round(Fraction(s, self.n)) for s in self.sums]
        rest = [float(Fraction(s, self.n) - m) for s, m in zip(self.sums, near)]
        return np.array(near, float), np.array(rest)

    def project(self, whole: np.ndarray) -> np.ndarray:
        """Whitened rows of a matrix of x; a component without variance gives 0."""
        near, rest = self._centre()
        k = self.components.shape[1]
        own = self.eigenvalues[:k]
        there = own > len(self.eigenvalues) * 4 * _EPS * max(self.eigenvalues[0], 0) if k else own > 0
        length = np.where(there, np.sqrt(np.where(there, own, 1)), np.inf)
        return ((whole - near) - rest) @ self.components / length

    def deviations(self, whole: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; None where a long can't hold it."""
        near = self._centre()[0]
        rest = [s - self.n * int(m) for s, m in zip(self.sums, near)]
        gap = whole - near
        largest = self.n * (np.abs(gap).max(initial=0) + 1)
        if largest * largest * max(len(rest), 1) < 2.0**62:
            exact = self.n * gap.astype(np.int64) - np.array(rest, np.int64)
            return np.einsum("ij,ij->i", exact, exact).tolist()
        sums = [sum((self.n * int(g) - r) ** 2 for g, r in zip(row, rest)) for row in gap.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def whole_vectors(vectors: DataFrame, scale: float, offset: int, *keep: str) -> DataFrame:
    """Usable vectors as whole numbers floor(scale * x) + offset, held as doubles, beside the columns to keep."""
    held = vectors.where(_finite(F.col("embedding"))).select("embedding", *keep)
    sizes = held.groupBy(F.size("embedding").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    held = held.where(F.size("embedding") == (common["size"] if common else 0))
    entry = lambda x: F.floor(x.cast("double") * scale).cast("double") + F.lit(float(offset))
    return held.select(F.transform("embedding", entry).alias("whole"), *keep)


def fit_whitening(whole: DataFrame, k: int, scale: float = 1024.0, offset: int = 100_000) -> Whitening:
    """The first `k` components of all vectors of `whole_vectors`.

    First the sums, then the products of what is left of the whole number next to the mean;
    both are exact while they stay below 2**53, so results don't depend on how rows are dealt.
    """
    rows = whole.select("whole")

    def sums(blocks: Iterator[np.ndarray]) -> dict[str, np.ndarray]:
        total: dict[str, np.ndarray] = {}
        for block in blocks:
            x = block.astype(np.int64)
            # In two halves, which can't overflow.
            own = {"n": np.array([len(x)]), "high": (x >> _HALF).sum(axis=0), "low": (x & ((1 << _HALF) - 1)).sum(axis=0)}
            total = {name: total[name] + v for name, v in own.items()} if total else own
        return total

    found = _summed(rows, sums, "lane bigint, n array<bigint>, high array<bigint>, low array<bigint>")
    if not found or len(found["high"]) == 0:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), scale, offset)
    n = int(found["n"][0])
    totals = [(int(h) << _HALF) + int(v) for h, v in zip(found["high"], found["low"])]
    model = Whitening(n, totals, np.zeros(0), np.zeros((0, 0)), scale, offset)
    near, rest = model._centre()

    def products(blocks: Iterator[np.ndarray]) -> dict[str, np.ndarray]:
        total = np.zeros((len(near), len(near)))
        for block in blocks:
            total += (block - near).T @ (block - near)
        return {"products": total}

    matrix = _summed(rows, products, "lane bigint, products array<double>")["products"].reshape(len(near), -1)
    values, vectors = spectral_components(matrix / n - np.outer(rest, rest))
    model.eigenvalues, model.components = np.maximum(values, 0), vectors[:, :k]
    model.identity_error = _identity_error(rows, model)
    return model


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity: one more pass over all of them."""
    k = model.components.shape[1]

    def sums(blocks: Iterator[np.ndarray]) -> dict[str, np.ndarray]:
        total, products = np.zeros(k), np.zeros((k, k))
        for block in blocks:
            own = model.project(block)
            total, products = total + own.sum(axis=0), products + own.T @ own
        return {"total": total, "products": products}

    found = _summed(rows, sums, "lane bigint, total array<double>, products array<double>")
    # Whitened rows are centred already: their mean is rounding.
    mean = found["total"] / model.n
    covariance = found["products"].reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(
    vectors: DataFrame, k: int = 8, scale: float = 1024.0, offset: int = 100_000
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every vector on `k` components.

    `vectors` has vec_id and embedding; entries become whole numbers floor(scale * c) + offset.
    All vectors are fitted. Components count from 1 by falling eigenvalue; fewer dimensions
    give fewer components.

    Defined cases: vectors that are NULL, empty, or hold a NULL, non-finite or too large entry (2**40)
    take no part, nor do vectors of another length than the commonest (the longer of equally common
    ones); rows without vec_id and rows that share one are rows like
    others; a component without variance has 0 as `whitened`, which `identity_error` then shows as
    1; where all vectors are equal `explained` is 0; a deviation that no long can hold is NULL. Other
    columns are not looked at. An empty table gives no rows.
    """
    kinds = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    with scratch_space(vectors.sparkSession):
        whole = whole_vectors(vectors.select("embedding", F.col("vec_id").cast("bigint").alias("vec_id")), scale, offset, "vec_id")
        model = fit_whitening(whole, k, scale, offset)
    width = model.components.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not width:
                continue
            block, rows = _matrix(batch.column(0)), batch.num_rows
            of_row = pa.array(np.repeat(np.arange(rows), width))
            columns = [
                batch.column(1).take(of_row),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * width, model.n)),
                pa.array(model.deviations(block), pa.int64()).take(of_row),
                pa.array(model.project(block).ravel()),
                pa.array(np.tile(model.explained[:width], rows)),
                pa.array(np.full(rows * width, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [k.split()[0] for k in kinds.split(", ")])

    return whole.mapInArrow(apply, kinds)
