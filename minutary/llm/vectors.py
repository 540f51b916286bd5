"""Near copies among vectors by Euclidean p-stable hashing (Datar et al. 2004).

Vectors of length one are projected on random Gaussian directions; each projection, shifted
and cut into cells of width `WIDTH`, gives a whole number, and the numbers of one table with
the label are a bucket. At cosine 0.93 two vectors are 0.374 apart and agree in one number with
chance 0.85, so with 14 numbers and 64 tables they share a bucket with chance 0.9992 (closer
ones more surely). Vectors of a bucket are compared by cosine in double precision.

Equal vectors are one point with a multiplicity. A large bucket is cut into chunks, each pair of
chunks being a task's work of its own. A pair is counted in the first table where it meets and only the
counts and a spanning forest leave the task, never pairs. Projections are computed in whole
numbers, exactly, so that every task sees the same buckets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from minutary.llm import batches, components as cc, hashing
from minutary.session import settle

COSINE = 0.93
TABLES = 64
PROJECTIONS = 14
WIDTH = 2.0
CHUNK = 256
SEED = 20240101
_VECTOR_UNIT, _DIRECTION_UNIT = 1 << 20, 1 << 10


@lru_cache(maxsize=8)
def _directions(dims: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and shifts, in whole units."""
    random = np.random.default_rng([SEED, dims])
    directions = np.rint(random.standard_normal((dims, tables * projections)) * _DIRECTION_UNIT)
    shifts = np.floor(random.random(tables * projections) * WIDTH * _VECTOR_UNIT * _DIRECTION_UNIT)
    return directions, shifts


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that no square overflows."""
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def buckets(rows: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS) -> np.ndarray:
    """(vectors, tables): one 64-bit hash of each table's numbers."""
    directions, shifts = _directions(rows.shape[1], tables, projections)
    # Whole numbers below 2^53: sums are exact in any order.
    places = np.floor((np.rint(rows * _VECTOR_UNIT) @ directions + shifts) / (WIDTH * _VECTOR_UNIT * _DIRECTION_UNIT))
    numbers = places.astype(np.int64).view(np.uint64).reshape(len(rows), tables, projections)
    key = np.zeros((len(rows), tables), dtype=np.uint64)
    for at in range(projections):
        key = (key ^ numbers[:, :, at]) * hashing.P1
        key ^= key >> np.uint64(31)
    return key


def _matrix(raw: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1)


def _bucket_rows(kind: np.dtype, tables: int, projections: int):
    """(node, place, bucket) for every point and table; place tells label, dimension and table apart."""

    def step(source):
        for batch in batches.pieces(source):
            raw = batch.column("raw").to_pylist()
            sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                keys = buckets(unit(_matrix([raw[at] for at in own], kind)), tables, projections)
                yield {
                    "node": np.repeat(batch.column("node").to_numpy()[own], tables),
                    "label": batch.column("label").take(np.repeat(own, tables)),
                    "dims": np.full(len(own) * tables, size // kind.itemsize, dtype=np.int32),
                    "place": np.tile(np.arange(tables, dtype=np.int32), len(own)),
                    "bucket": keys.ravel().view(np.int64),
                }

    return step


def _compare_blocks(kind: np.dtype, cosine: float, tables: int, projections: int):
    """For each block of points that share a bucket: (node, root, links)."""

    def linked(rows, at, first):
        """Which pairs of `at` are near, and which of those are new in this table."""
        x = unit(_matrix([rows["raw"][k] for k in at], kind))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        own = rows["own"][at]
        crossing = np.ones(len(i), dtype=bool) if first else own[i] != own[j]
        i, j = i[crossing], j[crossing]
        earlier = int(rows["place"][at[0]])
        if earlier and len(i):
            keys = buckets(x, tables, projections)[:, :earlier]
            new = ~(keys[i] == keys[j]).any(axis=1)
            i, j = i[new], j[new]
        return near, i, j

    def step(source):
        names = ["label", "dims", "place", "bucket", "first", "second"]
        for rows in batches.whole_runs(source, names):
            starts = batches.run_starts(*[rows[name] for name in names])
            ends = np.append(starts[1:], len(rows["node"]))
            nodes, roots, links = [], [], []
            # Most buckets hold two points that met by chance: one product for all of these.
            wanted = ends - starts > 1
            pairs = np.flatnonzero(ends - starts == 2)
            dims = rows["dims"][starts[pairs]]
            for size in np.unique(dims):
                own = pairs[dims == size]
                a, b = (unit(_matrix([rows["raw"][k] for k in each], kind)) for each in (starts[own], starts[own] + 1))
                wanted[own] = (a * b).sum(axis=1) >= cosine - 1e-9
            for start, end in zip(starts[wanted], ends[wanted]):
                at = np.arange(start, end)
                near, i, j = linked(rows, at, rows["first"][start] == rows["second"][start])
                if not near.any():
                    continue
                own = rows["node"][at]
                labels = own
                while True:
                    lower = np.minimum(labels, np.where(near, labels[None, :], np.iinfo(np.int64).max).min(axis=1))
                    if (lower == labels).all():
                        break
                    labels = lower
                counts = np.bincount(i, weights=rows["size"][at][j], minlength=len(at)).astype(np.int64)
                told = (labels != own) | (counts > 0)
                nodes.append(own[told])
                roots.append(labels[told])
                links.append(counts[told])
            if nodes:
                yield {"node": np.concatenate(nodes), "root": np.concatenate(roots), "links": np.concatenate(links)}

    return step


def _usable(vector: str, label: str):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def near_copies(
    vectors: DataFrame,
    cosine: float = COSINE,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    chunk: int = CHUNK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding, label).

    Rows with equal labels link at `cosine` or more; n_links counts the other rows linked
    directly; component_id is the smallest vec_id that links reach, the row's own included.
    Null labels, null or zero vectors, vectors with null or non-finite parts, and vectors of
    different lengths link with nothing. Rows that repeat a vec_id are vectors of their own. Null
    vec_ids name a component only if nothing else is in it. An empty table gives an empty one.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = np.dtype("<f4") if isinstance(element, T.FloatType) else np.dtype("<f8")
    narrow = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>" if kind.itemsize == 4 else "array<double>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    usable = narrow.filter(_usable("embedding", "label"))
    grouped = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"))
    # Written, so that a point keeps its number.
    points = settle(_with_bytes(grouped.withColumn("node", F.monotonically_increasing_id()), kind))
    keyed = settle(
        batches.map_arrow(
            points.select("node", "label", "raw"), _bucket_rows(kind, tables, projections), "node long, label string, dims int, place int, bucket long"
        )
    )
    cell = ["label", "dims", "place", "bucket"]
    shared = keyed.groupBy(*cell).count().filter("count > 1")
    chunks = F.ceil(F.col("count") / chunk).cast("int")
    dealt = (
        keyed.join(shared, cell)
        .select(*cell, "node", F.pmod(F.hash("node"), chunks).alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})
        .drop("other")
    )
    keys = [*cell, "first", "second"]
    blocks = dealt.join(points.select("node", "raw", "size"), "node").repartition(*keys).sortWithinPartitions(*keys)
    found = settle(batches.map_arrow(blocks, _compare_blocks(kind, cosine, tables, projections), "node long, root long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = cc.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    marked = (
        points.join(links, "node", "left")
        .join(parts, "node", "left")
        .select("label", "embedding", "vec_id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    lowest = marked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = marked.join(lowest, "component").select("label", "embedding", "n_links", "component_id")
    ours = usable.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = narrow.filter(~F.coalesce(_usable("embedding", "label"), F.lit(False)))
    everything = ours.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return everything.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _with_bytes(points: DataFrame, kind: np.dtype) -> DataFrame:
    """Adds `raw`, the vector as bytes: a number array costs a Python object for each part."""

    def step(source):
        for batch in batches.pieces(source):
            lists = batch.column("embedding")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield {name: batch.column(name) for name in batch.schema.names} | {"raw": raw}

    return batches.with_fields(points, points.columns, step, "raw binary")
