"""Embeddings on their principal axes, each scaled to variance 1.

Entries become whole numbers, so counts, sums and the scatter about the mean add up exactly in any order,
spread over tasks. What reaches the driver is one number per pair of dimensions. There the scatter is
factored by Cholesky with pivoting, and Jacobi rotations make the columns of the triangular factor
orthogonal: their squared norms are the eigenvalues, and the columns, normalised, the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from minutary.llm import batches
from minutary.session import settle

COMPONENTS = 8
# Fixed values of the contract: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
# Whole numbers up to here stand exactly in a double.
EXACT = 1 << 53
LARGEST_LONG = (1 << 63) - 1
ROWS_AT_ONCE = 1024
NUMBERS_IN_HAND = 1 << 20


class Axes(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column per component
    trace: float


def _ready(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _whole(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of `dims` entries, and their entries as whole numbers."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    places = np.flatnonzero(sizes == dims)
    # A null entry comes out as NaN.
    entries = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), dims)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(entries * SCALE)
        usable = (np.abs(scaled) < EXACT // 2).all(axis=1)
    return places[usable], scaled[usable].astype(np.int64) + SHIFT


def _totals(column: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """By length of vector and dimension, how many there are and their sum."""
    held: dict[int, list] = {}

    def rows() -> dict:
        sizes, dims, counts, sums = [], [], [], []
        for size, (count, total) in held.items():
            sizes += [size] * size
            dims += range(size)
            counts += [count] * size
            sums += [Decimal(int(value)) for value in total]
        held.clear()
        return {"size": sizes, "dim": dims, "n": counts, "total": sums}

    for piece in batches.pieces(column, ROWS_AT_ONCE):
        vectors = piece.column("embedding")
        for size in np.unique(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy()):
            if size < 1:
                continue
            _, whole = _whole(vectors, size)
            count, total = held.get(size, (0, np.zeros(size, dtype=object)))
            held[size] = (count + len(whole), total + whole.sum(axis=0).astype(object))
        if sum(held) > NUMBERS_IN_HAND:
            yield rows()
    yield rows()


def _products(off: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of columns, exactly, as Python's whole numbers."""
    largest = int(np.abs(off).max(initial=0))
    if largest * largest >= EXACT:
        return off.astype(object).T @ off.astype(object)
    total = np.zeros((off.shape[1], off.shape[1]), dtype=object)
    step = EXACT // max(largest * largest, 1)
    for start in range(0, len(off), step):
        part = off[start : start + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def covariance(embeddings: DataFrame) -> tuple[int, list[int], np.ndarray] | None:
    """(count, sum of each dimension, covariance with divisor count); nothing without a vector.

    The products are of offsets from the whole number next to the mean; what the mean itself is off
    by is taken away from whole numbers, so nothing is rounded before the last division.
    """
    ready = _ready(embeddings)
    each = batches.map_arrow(ready, _totals, "size int, dim int, n long, total decimal(38,0)")
    totals = settle(each.groupBy("size", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    common = totals.filter("dim = 0 AND n > 0").orderBy(F.desc("n"), "size").first()
    if common is None:
        return None
    n, dims = common.n, common["size"]
    found = {row.dim: int(row.total) for row in totals.filter(F.col("size") == dims).collect()}
    sums = [found[dim] for dim in range(dims)]
    middle = [(2 * total + n) // (2 * n) for total in sums]

    def scatter(column: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros((dims, dims), dtype=object)
        for piece in batches.pieces(column, ROWS_AT_ONCE):
            _, whole = _whole(piece.column("embedding"), dims)
            total = total + _products(whole - np.array(middle))
        for a in range(dims):
            yield {"a": [a] * (dims - a), "b": range(a, dims), "total": [Decimal(int(value)) for value in total[a, a:]]}

    each = batches.map_arrow(ready, scatter, "a int, b int, total decimal(38,0)")
    offset = [total - n * place for total, place in zip(sums, middle)]
    found = np.zeros((dims, dims))
    for row in each.groupBy("a", "b").agg(F.sum("total").alias("total")).toLocalIterator():
        exact = n * int(row.total) - offset[row.a] * offset[row.b]
        found[row.a, row.b] = found[row.b, row.a] = exact / (n * n)
    return n, sums, found


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, factor): matrix[order][:, order] is factor @ factor.T. The largest diagonal entry left
    comes next, and the factor has as many columns as the matrix has rank."""
    left, size = matrix.copy(), len(matrix)
    order, factor = np.arange(size), np.zeros_like(matrix)
    least = size * np.finfo(float).eps * left.diagonal().max(initial=0.0)
    for at in range(size):
        pivot = at + int(np.argmax(left.diagonal()[at:]))
        if left[pivot, pivot] <= least:
            return order, factor[:, :at]
        for swapped in (left, left.T, factor):
            swapped[[at, pivot]] = swapped[[pivot, at]]
        order[[at, pivot]] = order[[pivot, at]]
        factor[at, at] = np.sqrt(left[at, at])
        factor[at + 1 :, at] = left[at + 1 :, at] / factor[at, at]
        left[at + 1 :, at + 1 :] -= np.outer(factor[at + 1 :, at], factor[at + 1 :, at])
    return order, factor


def _rounds(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds in which no column is twice (as a tournament is drawn)."""
    seats = list(range(size + size % 2))
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats, reversed(seats[len(seats) // 2 :])) if max(a, b) < size]
        yield np.array([min(pair) for pair in pairs], dtype=int), np.array([max(pair) for pair in pairs], dtype=int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times rotations that make its columns orthogonal: one-sided Jacobi."""
    found, near = factor.copy(), 4 * np.finfo(float).eps
    for _ in range(sweeps):
        most = 0.0
        for a, b in _rounds(found.shape[1]):
            left, right = found[:, a], found[:, b]
            p, q, both = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
            angle = np.abs(both) / np.sqrt(p * q)
            most = max(most, angle.max(initial=0.0))
            turned = angle > near
            slope = np.divide(q - p, 2 * both, out=np.zeros_like(p), where=turned)
            tangent = np.where(slope >= 0, 1.0, -1.0) / (np.abs(slope) + np.sqrt(1 + slope * slope))
            cosine = np.where(turned, 1 / np.sqrt(1 + tangent * tangent), 1.0)
            sine = np.where(turned, cosine * tangent, 0.0)
            found[:, a], found[:, b] = cosine * left - sine * right, sine * left + cosine * right
        if most <= near:
            break
    return found


def learn(embeddings: DataFrame, components: int = COMPONENTS) -> Axes | None:
    """The axes of `embeddings` (vec_id, embedding); nothing without a usable vector.

    Vectors that are null, empty or hold a null or an entry that is not finite are left out, and so are those
    with an entry of 2^42 or more, whose whole number no double holds, and, where lengths differ, all but those of the most
    frequent length (of equally frequent ones the shortest). Components of variance 0 do not count.
    """
    found = covariance(embeddings)
    if found is None:
        return None
    n, sums, matrix = found
    order, factor = pivoted_cholesky(matrix)
    turned = orthogonal_columns(factor)
    values = (turned * turned).sum(axis=0)
    best = np.argsort(-values, kind="stable")[:components]
    vectors = np.zeros((len(matrix), len(best)))
    vectors[order] = turned[:, best] / np.sqrt(values[best])
    return Axes(n, sums, values[best], vectors, float(matrix.trace()))


def project(embeddings: DataFrame, axes: Axes) -> DataFrame:
    """(vec_id, deviation, whitened) of the vectors that `learn` takes: the squared distance from the mean times the squared
    count, which is whole (null if it is beyond a long), and the coordinates on the axes."""
    n, sums, dims = axes.n, axes.sums, len(axes.sums)
    middle = [(2 * total + n) // (2 * n) for total in sums]
    offset = [total - n * place for total, place in zip(sums, middle)]
    scaled = axes.vectors / np.sqrt(axes.values)

    def run(column: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for piece in batches.pieces(column, ROWS_AT_ONCE):
            places, whole = _whole(piece.column("embedding"), dims)
            off = whole - np.array(middle)
            reach = n * int(np.abs(off).max(initial=0)) + n
            kind = np.int64 if reach * reach * dims <= LARGEST_LONG else object
            apart = off.astype(kind) * n - np.array(offset, dtype=kind)
            squared = (apart * apart).sum(axis=1)
            coordinates = (apart / n).astype(np.float64) @ scaled
            ends = np.arange(len(places) + 1, dtype=np.int32) * coordinates.shape[1]
            yield {
                "vec_id": piece.column("vec_id").take(pa.array(places)),
                "deviation": [int(value) if value <= LARGEST_LONG else None for value in squared],
                "whitened": pa.ListArray.from_arrays(pa.array(ends), pa.array(coordinates.ravel())),
            }

    added = "deviation long, whitened array<double>"
    return batches.with_fields(_ready(embeddings), ["vec_id"], run, added)


def identity_error(whitened: DataFrame, components: int, n: int) -> float:
    """Largest entry by which the covariance of the coordinates is off from the identity."""
    if not components:
        return 0.0
    entries = [F.get("whitened", F.lit(at)) for at in range(components)]
    means = whitened.agg(*[F.avg(entry) for entry in entries]).first()
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    products = [F.sum((entries[a] - means[a]) * (entries[b] - means[b])) for a, b in pairs]
    sums = whitened.agg(*products).first()
    return max(abs(total / n - (a == b)) for (a, b), total in zip(pairs, sums))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector that `learn` takes and component, numbered from 1 by falling variance: (vec_id, component, n,
    deviation, whitened, explained, identity_error). Repeated rows each have their own; a null id stays null.
    Without a usable vector, or if all are equal, there are no rows. Other columns are not looked at."""
    axes = learn(embeddings, components)
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if axes is None:
        kind = embeddings.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, {schema}")
    placed = settle(project(embeddings, axes))
    error = identity_error(placed, len(axes.values), axes.n)
    shares = F.array(*[F.lit(float(value / axes.trace)) for value in axes.values]).cast("array<double>")
    spread = placed.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return spread.select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(axes.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
