"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries are put on a grid: c becomes the whole number floor(GRID * c) + OFFSET. So sums and products are whole numbers, exact
in any order of rows and tasks, and a model doesn't depend on how the table is dealt.

1. Tasks sum the entries by dimension; products of entries are summed after the rounded mean is taken off, so that they stay
   small, and the rest of the mean is taken off exactly at the end. A task gives a row a pair of dimensions, Spark adds them, and the
   driver sees one row a pair: its memory depends on the dimensions and not on the rows.
2. The scatter S is factored P' S P = L L' with complete pivoting; where the largest rest falls under rounding the rank is reached.
3. The columns of L are rotated in pairs until they are orthogonal. As S = L L' and a rotation R leaves (L R)(L R)' as it is, the squared
   norms of the columns are then the eigenvalues and the columns over their norms the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows multiplied at a time, and bits of a number that are multiplied at a time: together under the 53 bits of a double.
BLOCK, LIMB = 1 << 13, 20
#: Entries beyond this are an error: they wouldn't fit into a long.
LARGEST = float(1 << 61)


@dataclass
class Whitener:
    """Of n vectors: the rounded mean of each dimension, n times what is left of the mean, eigenvalues falling, unit components as columns,
    and the trace of the covariance."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sum over all vectors: whole numbers, as objects where a long can't be sure to hold them."""
        y = x - self.centre
        large = len(y) and int(np.abs(y).max()) * self.n + self.n >= 1 << 62
        return y.astype(object) * self.n - self.rest.astype(object) if large else y * self.n - self.rest

    def deviations(self, scaled: np.ndarray) -> np.ndarray:
        """Each vector's sum of squares, exactly; beyond a long it is an error."""
        if scaled.dtype != object and len(scaled) and float(np.abs(scaled).max()) ** 2 * scaled.shape[1] < 2.0**62:
            return (scaled * scaled).sum(axis=1)
        return np.array([sum(int(v) ** 2 for v in row) for row in scaled], np.int64)

    def whiten(self, scaled: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.eigenvalues))
        return (scaled.astype(float) / self.n) @ (self.components[:, :k] / np.sqrt(self.eigenvalues[:k]))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of shape (dimensions, rank) with a = L L', its rows in the order of a: triangular if they were ordered as pivoted."""
    d = len(a)
    diagonal, out, free = np.diag(a).copy(), np.zeros((d, d)), np.ones(d, bool)
    least = d * np.finfo(float).eps * max(float(diagonal.max(initial=0.0)), 0.0)
    for k in range(d):
        p = int(np.argmax(np.where(free, diagonal, -np.inf)))
        if diagonal[p] <= least:
            return out[:, :k]
        free[p] = False
        out[p, k] = np.sqrt(diagonal[p])
        out[free, k] = (a[free, p] - out[free, :k] @ out[p, :k]) / out[p, k]
        diagonal[free] -= out[free, k] ** 2
    return out


def orthogonalised(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns after rotations that make them orthogonal, by falling norm. Pairs are dealt as in a tournament: a round rotates pairs that
    have no column in common, all at once."""
    r = columns.shape[1]
    if r < 2:
        return columns
    a = np.column_stack([columns, np.zeros((len(columns), r % 2))])
    order = np.arange(a.shape[1])
    half = len(order) // 2
    least = 2 * np.finfo(float).eps * np.sqrt(len(columns))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(order) - 1):
            one, two = order[:half], order[half:][::-1]
            x, y = a[:, one], a[:, two]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            live = np.abs(xy) > least * np.sqrt(xx * yy)
            if live.any():
                turned = True
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    zeta = (yy - xx) / (2 * xy)
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                t = np.where(live, t, 0.0)
                c = 1 / np.sqrt(1 + t * t)
                a[:, one], a[:, two] = c * x - c * t * y, c * t * x + c * y
            order = np.concatenate([order[:1], np.roll(order[1:], 1)])
        if not turned:
            break
    norms = (a * a).sum(axis=0)
    best = np.argsort(-norms, kind="stable")[:r]
    return a[:, best]


def usable(vector: Column) -> Column:
    """A vector without null and non-finite entries."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def usable_rows(vectors: DataFrame, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector is usable and as long as most are (of two lengths equally common the greater), and that length; 0 without rows."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.where(usable(vector))
    most = rows.groupBy(F.size(vector_col).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return (rows.where(F.size(vector_col) == most["size"]), most["size"]) if most else (rows, 0)


def _on_grid(column: pa.Array, dims: int, grid: int, offset: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * float(grid)
    if np.abs(flat).max(initial=0.0) >= LARGEST:
        raise ArithmeticError("an entry of a vector is too large for a whole number of 64 bits")
    return np.floor(flat).astype(np.int64) + offset


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums of longs, as objects; fewer than 2 ** 31 rows."""
    return ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y of longs, as objects: numbers are cut into limbs whose products add up exactly in doubles."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for lo in range(0, len(y), BLOCK):
        rest, limbs = y[lo : lo + BLOCK], []
        while True:
            low = ((rest + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
            limbs.append(low.astype(float))
            rest = (rest - low) >> LIMB
            if not rest.any():
                break
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([str(int(v)) for v in values], pa.string())


def fit(vectors: DataFrame, *, vector_col: str = "embedding", grid: int = GRID, offset: int = OFFSET) -> Whitener:
    """The whitener of all usable vectors: covariance over them with divisor n.

    Null vectors, empty ones, those with null or non-finite entries, and those of another length than most have are left out; repeated
    rows count each. Equal vectors only, or no rows, give no components. Other columns aren't read. An entry too large for a long is
    an error. The driver holds a number a pair of dimensions."""
    rows, dims = usable_rows(vectors, vector_col)
    if not dims:
        return Whitener(0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    slim = rows.select(F.col(vector_col).cast("array<double>").alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, object), 0
        for batch in batches:
            total, n = total + exact_sums(_on_grid(batch.column(0), dims, grid, offset)), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), _decimals([*total, n])], names=["at", "value"])

    def added(out: DataFrame, *keys: str) -> list:
        return out.groupBy(*keys).agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()

    got = {r["at"]: int(r["value"]) for r in added(slim.mapInArrow(sums, "at long, value string"), "at")}
    n, total = got[dims], [got[i] for i in range(dims)]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    one, two = np.triu_indices(dims)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            total += exact_products(_on_grid(batch.column(0), dims, grid, offset) - centre)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), _decimals(total[one, two].tolist())], names=["i", "j", "value"])

    scatter = np.zeros((dims, dims))
    for r in added(slim.mapInArrow(products, "i long, j long, value string"), "i", "j"):
        scatter[r["i"], r["j"]] = scatter[r["j"], r["i"]] = (n * int(r["value"]) - rest[r["i"]] * rest[r["j"]]) / n
    turned = orthogonalised(pivoted_cholesky(scatter))
    norms = np.sqrt((turned * turned).sum(axis=0))
    return Whitener(n, centre, np.array(rest, np.int64), norms**2 / n, turned / norms, float(np.trace(scatter)) / n)


def whitened(vectors: DataFrame, model: Whitener, *, vector_col: str = "embedding", components: int = COMPONENTS, grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """The usable rows of the model's length with `deviation` (sum over dimensions of (n * x - sum of x) ** 2, exact) and `whitened`, the
    vector on the first `components` components, each over the root of its eigenvalue; columns of these names are replaced.

    Rows that `fit` leaves out are left out; repeated rows get equal answers. A deviation beyond a long is an error."""
    dims = len(model.centre)
    base = vectors.drop("deviation", "whitened")
    rows = base.where(usable(F.col(vector_col).cast("array<double>")) & (F.size(vector_col) == dims))
    schema = T.StructType([*base.schema.fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    held = vectors.sparkSession.sparkContext.broadcast(model)  # some dimensions squared numbers
    at = base.columns.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = held.value.scaled(_on_grid(batch.column(at), dims, grid, offset))
            out = held.value.whiten(scaled, components)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.deviations(scaled)), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def identity_error(rows: DataFrame, whitened_col: str = "whitened") -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n) minus the identity; 0 without components. Whitened vectors have
    mean zero up to rounding, which is taken off all the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            w = np.column_stack([w, np.ones(len(w))])
            n, total = n + len(w), w.T @ w if total is None else total + w.T @ w
        if n and len(total) > 1:
            one, two = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(total[one, two])], names=["i", "j", "value"])

    sums = rows.select(whitened_col).mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # a row a pair of components
    if not sums:
        return 0.0
    k = max(r["j"] for r in sums)
    total = np.zeros((k + 1, k + 1))
    for r in sums:
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["value"]
    mean = total[:k, k] / total[k, k]
    return float(np.abs(total[:k, :k] / total[k, k] - np.outer(mean, mean) - np.eye(k)).max())
