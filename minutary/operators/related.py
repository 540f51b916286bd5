"""Meetings most like a meeting, by the cosine of their vectors: exact k nearest neighbours.

Vectors of length 1 lie in cells around a few pivots. A cell's vectors are kept in order of their distance
from its pivot, in blocks. What a vector finds in its own block says how far it has to look, and by the triangle inequality
a block at other distances from its pivot than that need not be looked at. Blocks that are left are
compared as matrices, and each vector keeps the k best of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from minutary.operators.terms import top_per
from minutary.session import settle

PIVOTS = 32
BLOCK_ROWS = 8192
ASKED_AT_ONCE = 256
# Groups of asking vectors that meet one block in one task.
GROUPS_PER_LANE = 4096
BUCKET = 0.125
PLACES = 6
# More than rounding can move a cosine.
SLACK = 2e-6
# Above so many times k entries a row, the k best are picked before they are put in order.
MANY = 64

_BEST = pa.list_(pa.struct([("related_id", pa.int64()), ("cosine", pa.float64())]))
_RANGES = pa.list_(pa.struct([("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))
_PLACED = pa.schema(
    [("block", pa.int64()), ("cell", pa.int32()), ("r", pa.float64()), ("vec_id", pa.int64()), ("unit", pa.binary()),
     ("asking", pa.int64()), ("least", pa.float64()), ("best", _BEST), ("ranges", _RANGES)]
)
_PLACED_DDL = (
    "block long, cell int, r double, vec_id long, unit binary, asking long, least double, "
    "best array<struct<related_id: long, cosine: double>>, ranges array<struct<cell: int, low: double, high: double>>"
)


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors with an id that have a direction: not null, not zero, all entries finite."""
    entries = F.col("embedding").cast("array<double>")
    fine = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = vectors.filter("vec_id IS NOT NULL").withColumn("embedding", entries)
    return known.filter(fine & F.exists("embedding", lambda x: x != 0))


def _units(column: pa.ListArray, dims: int) -> np.ndarray:
    rows = column.flatten().to_numpy().reshape(len(column), dims)
    # Scaled first, as squares of extreme entries would leave the range of a double.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _packed(units: np.ndarray) -> pa.Array:
    size = units.shape[1] * 8
    offsets = pa.py_buffer(np.arange(len(units) + 1, dtype=np.int32) * size)
    return pa.Array.from_buffers(pa.binary(), len(units), [None, offsets, pa.py_buffer(np.ascontiguousarray(units))])


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dims)


def _apart(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T)))


def k_best(ids: np.ndarray, cosines: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest cosines of each row that are at least `least`, ties by id, without the row's own id."""
    cosines = np.where(ids[None, :] == own[:, None], -np.inf, cosines)
    if cosines.shape[1] > k:
        kth = -np.partition(-cosines, k - 1, axis=1)[:, k - 1]
        least = np.maximum(least, kth)
    row, column = np.nonzero((cosines >= least[:, None]) & np.isfinite(cosines))
    order = np.lexsort((ids[column], -cosines[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _rounded(cosines: np.ndarray) -> np.ndarray:
    return np.round(cosines, PLACES) + 0.0


def _better(ids: np.ndarray, cosines: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own id, id, rounded cosine) of what `k_best` gives. Only entries that can reach `least`, as a rule few, are rounded and ranked."""
    near = cosines >= (least - SLACK)[:, None]
    if np.count_nonzero(near) > MANY * k * len(own):
        cosines = _rounded(cosines)
        row, column = k_best(ids, cosines, own, k, least)
        return own[row], ids[column], cosines[row, column]
    row, column = np.nonzero(near)
    rounded = _rounded(cosines[row, column])
    kept = (rounded >= least[row]) & (ids[column] != own[row])
    row, column, rounded = row[kept], column[kept], rounded[kept]
    order = np.lexsort((ids[column], -rounded, row))
    row, column, rounded = row[order], column[order], rounded[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return own[row[first]], ids[column[first]], rounded[first]


def _block(number: int, cell: int, rows: pa.Table, pivots: np.ndarray, k: int) -> pa.RecordBatch:
    """The rows of a block, and what those that ask find in it."""
    dims = pivots.shape[1]
    units, ids = _unpacked(rows.column("unit"), dims), rows.column("vec_id").to_numpy()
    asked = np.flatnonzero(rows.column("asked").to_numpy())
    asking, least, best, ranges = [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids)
    for group, start in enumerate(range(0, len(asked), ASKED_AT_ONCE)):
        own = asked[start : start + ASKED_AT_ONCE]
        cosines = _rounded(units[own] @ units.T)
        row, column = k_best(ids, cosines, ids[own], k, np.full(len(own), -np.inf))
        # A row that finds fewer than k here has to look everywhere.
        counts, lowest = np.bincount(row, minlength=len(own)), np.full(len(own), 2.0)
        np.minimum.at(lowest, row, cosines[row, column])
        lowest[counts < k] = -1.0
        reach = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (lowest - SLACK)))
        away = _apart(units[own], pivots)
        low, high = (away - reach[:, None]).min(axis=0), (away + reach[:, None]).max(axis=0)
        ends = np.searchsorted(row, np.arange(len(own) + 1))
        for at, place in enumerate(own):
            asking[place], least[place] = number * BLOCK_ROWS + group, float(lowest[at])
            found = range(ends[at], ends[at + 1])
            best[place] = [{"related_id": int(ids[column[x]]), "cosine": float(cosines[at, column[x]])} for x in found]
        ranges[own[0]] = [{"cell": c, "low": float(a), "high": float(b)} for c, (a, b) in enumerate(zip(low, high))]
    columns = [
        pa.array(np.full(len(ids), number)), pa.array(np.full(len(ids), cell, dtype=np.int32)), rows.column("r").combine_chunks(),
        pa.array(ids), _packed(units), pa.array(asking, pa.int64()), pa.array(least, pa.float64()), pa.array(best, _BEST), pa.array(ranges, _RANGES),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_PLACED)


def _pivots(known: DataFrame, count: int) -> tuple[int, np.ndarray] | None:
    """The number of vectors of the most frequent length, and the first `count` of them in order of a hash."""
    sizes = known.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return None
    alike = known.filter(F.size("embedding") == sizes["size"])
    picked = alike.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).select("embedding").collect()
    return sizes["count"], _units(pa.array([row.embedding for row in picked], pa.list_(pa.float64())), sizes["size"])


def place(vectors: DataFrame, k: int, asked: Column | None = None, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """Vectors in blocks, each with its cell and distance; those that ask also with the k best of their block. Written out."""
    known = usable(vectors)
    picked = _pivots(known, pivots)
    if picked is None:
        return None
    count, corners = picked
    dims = corners.shape[1]
    kept = known.filter(F.size("embedding") == dims)
    flag = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    rows = (
        kept.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", flag.alias("asked"))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.bool_or("asked").alias("asked"))
        .select("vec_id", "embedding", "asked")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column("embedding"), dims)
            away = _apart(units, corners)
            cell = away.argmin(axis=1)
            columns = [pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("asked"), _packed(units), *columns], ["vec_id", "asked", "unit", "cell", "r"]
            )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell, held = TaskContext.get().partitionId() << 24, None, []

        def done() -> pa.RecordBatch:
            return _block(number, cell, pa.concat_tables(held), corners, k)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            cells = table.column("cell").to_numpy()
            at = 0
            while at < len(cells):
                size = sum(map(len, held))
                if held and (cells[at] != cell or size >= block_rows):
                    yield done()
                    number, held, size = number + 1, [], 0
                cell = int(cells[at])
                end = min(int(np.searchsorted(cells, cell, side="right")), at + block_rows - size)
                held.append(table.slice(at, end - at))
                at = end
        if held:
            yield done()

    partitions = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // (4 * block_rows) + 1)
    order = ["cell", "r", "vec_id"]
    measured = rows.mapInArrow(measure, "vec_id long, asked boolean, unit binary, cell int, r double")
    ranged = measured.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return settle(ranged.mapInArrow(blocks, _PLACED_DDL))


def open_pairs(placed: DataFrame) -> DataFrame:
    """(asking, lane, block): groups of asking vectors, and the blocks in which one of them may find better.

    Distances are cut into buckets, so that ranges meet by equal keys; a pair counts where its later start lies.
    """
    first = lambda name: F.floor(F.greatest(F.col(name), F.lit(0.0)) / BUCKET)
    last = lambda name: F.floor(F.least(F.col(name), F.lit(2.0)) / BUCKET)
    spans = placed.groupBy("block", "cell").agg(F.min("r").alias("from"), F.max("r").alias("to"))
    there = spans.withColumn("bucket", F.explode(F.sequence(first("from"), last("to"))))
    wanted = placed.filter("ranges IS NOT NULL").select("asking", F.col("block").alias("home"), F.inline("ranges"))
    looked = wanted.filter("high >= 0 AND low <= 2").withColumn("bucket", F.explode(F.sequence(first("low"), last("high"))))
    met = looked.join(there, ["cell", "bucket"]).filter(
        (F.col("bucket") == F.greatest(first("low"), first("from")))
        & (F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from")) & (F.col("home") != F.col("block"))
    )
    lane = F.pmod(F.xxhash64("asking"), F.lit(1 + placed.filter("ranges IS NOT NULL").count() // GROUPS_PER_LANE))
    return met.select("asking", lane.alias("lane"), "block")


def _compare(k: int, dims: int):
    """Rows in order of (block, lane, side): the block's vectors, and then all that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, units, ids, parts = None, None, None, []
        for batch in batches:
            side = batch.column("side").to_numpy()
            keys = np.stack([batch.column(name).to_numpy() for name in ("block", "lane")], axis=1)
            changes = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(side) != 0)) + 1
            for start, end in zip([0, *changes], [*changes, len(side)]):
                own, part = tuple(keys[start]), batch.slice(start, end - start)
                if own != key:
                    key, units, parts = own, None, []
                if side[start] == 0:
                    parts.append(part)
                    continue
                if units is None:
                    units = np.concatenate([_unpacked(each.column("unit"), dims) for each in parts])
                    ids = np.concatenate([each.column("vec_id").to_numpy() for each in parts])
                for at in range(0, part.num_rows, ASKED_AT_ONCE):
                    asking = part.slice(at, ASKED_AT_ONCE)
                    who = asking.column("vec_id").to_numpy()
                    found = _better(ids, _unpacked(asking.column("unit"), dims) @ units.T, who, k, asking.column("least").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(each) for each in found], ["vec_id", "related_id", "cosine"])

    return run


def related_meetings(vectors: DataFrame, k: int, asked: Column | None = None, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, rank, related_id, cosine): for each vector its k nearest others by cosine, ties by id; exact.

    `asked`, a condition on the rows of `vectors` (vec_id, embedding), restricts who looks, not who is found. Cosines have six
    places and are ranked so. A vector without an id, null, zero or with an entry that is null or not finite, takes no part,
    nor does one of another length than the most frequent (of equally frequent ones the shortest). Of several rows of one
    id the first in order of vectors counts. Fewer than k others are all given.
    """
    placed = place(vectors, k, asked, pivots, block_rows)
    if placed is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, rank int, related_id long, cosine double")
    dims = len(placed.select("unit").first()["unit"]) // 8
    pairs = settle(open_pairs(placed))
    looking = placed.filter("asking IS NOT NULL")
    asks = pairs.join(looking.select("asking", "vec_id", "unit", "least"), "asking")
    asks = asks.select("block", "lane", F.lit(1).alias("side"), "vec_id", "unit", "least")
    there = pairs.select("block", "lane").distinct().join(placed.select("block", "vec_id", "unit"), "block")
    there = there.select("block", "lane", F.lit(0).alias("side"), "vec_id", "unit")
    both = asks.unionByName(there, allowMissingColumns=True).repartition("block", "lane").sortWithinPartitions("block", "lane", "side")
    found = both.mapInArrow(_compare(k, dims), "vec_id long, related_id long, cosine double")
    at_home = looking.select("vec_id", F.inline("best"))
    best = top_per(at_home.unionByName(found), ["vec_id"], [F.desc("cosine"), F.col("related_id")], k, "rank")
    return best.select("vec_id", "rank", "related_id", "cosine")
