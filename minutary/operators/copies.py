"""Near copies among minutes and other documents: banded MinHash, confirmed by exact Jaccard similarity.

Texts are sets of hashed runs of five words. Texts whose signatures agree in a band share a bucket. In a bucket not all
are compared with all: two hubs are compared with every member, who is linked to a hub needs no more to be
in its group, and what is left is compared where distances from the hubs, which obey the triangle inequality,
leave it possible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from minutary.functions import text as tx
from minutary.operators.groups import groups
from minutary.session import settle

SHINGLE_WORDS = 5
# Odd numbers by which the hashes of a run's words are added up.
FACTORS = np.random.default_rng(5).integers(1, 1 << 63, size=SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
THRESHOLD = 0.8
# A pair at 0.8 agrees in some band with a chance of 0.992, at 0.85 of 0.9998.
BANDS, ROWS_PER_BAND = 26, 8
# Texts whose words fit in a processor's cache together.
VALUES_AT_ONCE = 1 << 15
# More than rounding can move a distance.
SLACK = 1e-9
BUCKET = ["band", "value"]


def _runs(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of five words of each text, hashed, and how many it has; of fewer words, all of them are one run."""
    sizes = words.value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(owner))
    hashes = np.append(words.flatten().to_numpy().view(np.uint64), np.zeros(SHINGLE_WORDS, dtype=np.uint64))
    values = (sizes[owner] * (sizes[owner] < SHINGLE_WORDS)).astype(np.uint64)
    for ahead, factor in enumerate(FACTORS):
        values += hashes[ahead : ahead + len(owner)] * factor * (left > ahead)
    opens = (left >= SHINGLE_WORDS) | ((sizes[owner] < SHINGLE_WORDS) & (left == sizes[owner]))
    values, owner = values[opens], owner[opens]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], np.bincount(owner[first], minlength=len(sizes))


def _bands(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bands of each set: hashes of the smallest values under several mixings. Empty sets have zeros."""
    mixers = np.random.default_rng(1).integers(1, 1 << 63, size=(BANDS * ROWS_PER_BAND, 2), dtype=np.uint64) | np.uint64(1)
    bands, filled = np.zeros((len(sizes), BANDS), dtype=np.uint64), sizes > 0
    if not filled.any():
        return bands.view(np.int64)
    starts = (np.cumsum(sizes) - sizes)[filled]
    own, mixed, shifted = bands[filled], np.empty_like(values), np.empty_like(values)
    for at, (by, plus) in enumerate(mixers):
        np.multiply(values, by, out=mixed)
        np.add(mixed, plus, out=mixed)
        np.right_shift(mixed, np.uint64(31), out=shifted)
        np.bitwise_xor(mixed, shifted, out=mixed)
        np.multiply(mixed, by, out=mixed)
        band = at // ROWS_PER_BAND
        own[:, band] = (own[:, band] ^ np.minimum.reduceat(mixed, starts)) * np.uint64(0x9E3779B97F4A7C15)
        own[:, band] ^= own[:, band] >> np.uint64(29)
    bands[filled] = own
    return bands.view(np.int64)


def _listed(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that about VALUES_AT_ONCE entries of a list column are in each."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().to_numpy().astype(np.int64)) // VALUES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), batch.num_rows]
        yield from (batch.slice(start, end - start) for start, end in zip(cuts, cuts[1:]) if end > start)


def _signatures(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...] = ("id", "size")) -> Iterator[pa.RecordBatch]:
    """Sets of runs with their bands."""
    for piece in _pieces(batches, "runs"):
        sizes = piece.column("runs").value_lengths().to_numpy()
        bands = _bands(piece.column("runs").flatten().to_numpy().view(np.uint64), sizes)
        columns = [*(piece.column(name) for name in keep), _listed(bands.ravel(), np.full(len(sizes), BANDS))]
        yield pa.RecordBatch.from_arrays(columns, [*keep, "bands"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, given by the hashes of their words, with their runs and bands."""

    def with_runs() -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, "words"):
            values, sizes = _runs(piece.column("words"))
            columns = [piece.column("id"), piece.column("key"), pa.array(sizes.astype(np.int32)), _listed(values, sizes)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "size", "runs"])

    return _signatures(with_runs(), ("id", "key", "size", "runs"))


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id) and (id, key, size, runs, bands): each document's text, which goes by the smallest document that has
    the same words, and the runs of each different text. What both are read from is written out."""
    words = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), tx.word_list(F.coalesce("text", F.lit(""))).alias("said"))
    hashed = words.select("id", F.sha2(F.array_join("said", " "), 256).alias("key"), F.transform("said", lambda word: F.xxhash64(word)).alias("words"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = settle(hashed.mapInArrow(_signed, f"id {kind}, key string, size int, runs array<long>, bands array<long>"))
    named = keyed.groupBy("key").agg(F.min("id").alias("id"))
    members = keyed.select(F.col("id").alias("doc_id"), "key").join(named, "key").select("doc_id", "id").distinct()
    # Of equal texts one row is enough; they differ in nothing but the id.
    return members, keyed.join(named, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])


def _similar(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Add `similarity`, the exact Jaccard similarity of the sets of a and b."""
    sets = lambda name: runs.select(F.col("id").alias(name), F.col("runs").alias(f"_{name}"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.withColumn("similarity", common / (F.size("_a") + F.size("_b") - common)).drop("_a", "_b")


def _hub_pairs(members: DataFrame, round_of: int) -> DataFrame:
    """Each bucket's hub, drawn by a hash from the members that still look for one, with every other member."""
    drawn = F.when(F.col("alone"), F.struct(F.xxhash64("id", F.lit(round_of)).alias("h"), "id"))
    hubs = members.groupBy(*BUCKET).agg(F.min(drawn)["id"].alias("hub")).filter("hub IS NOT NULL")
    return members.join(hubs, BUCKET)


def _with_distance(members: DataFrame, runs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Members with their distance from the hub, and the pairs compared. Written out."""
    pairs = members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    compared = settle(_similar(pairs, runs))
    apart = compared.select(F.col("a").alias("hub"), F.col("b").alias("id"), (1 - F.col("similarity")).alias(name))
    return settle(members.join(apart, ["hub", "id"], "left").fillna(0.0, [name])), compared


def _left_over(members: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of one bucket, not in one group yet, that the hubs leave possible.

    One of them is outside the bucket's largest group, so a group of very many members is not paired with itself.
    """
    reach = 1 - threshold + SLACK
    labelled = members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))
    labelled = labelled.withColumn("cell", F.floor(F.col("d1") / reach).cast("int"))
    sizes = labelled.groupBy(*BUCKET, "group_id").count()
    largest = sizes.groupBy(*BUCKET).agg(F.max_by("group_id", F.struct("count", "group_id")).alias("largest"))
    few = labelled.join(largest, BUCKET).filter("group_id <> largest")
    few = few.select(*BUCKET, *[F.col(name).alias(f"_{name}") for name in ("id", "size", "d1", "d2", "group_id")],
                     F.explode(F.array(*[F.col("cell") + step for step in (-1, 0, 1)])).alias("cell"))
    near = few.join(labelled, [*BUCKET, "cell"]).filter(
        (F.col("_group_id") != F.col("group_id"))
        & (F.abs(F.col("_d1") - F.col("d1")) <= reach) & (F.abs(F.col("_d2") - F.col("d2")) <= reach)
        & (F.least("_size", "size") >= (threshold - SLACK) * F.greatest("_size", "size"))
    )
    return near.select(F.least("_id", "id").alias("a"), F.greatest("_id", "id").alias("b")).distinct()


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, texts): each document's group, named by its smallest document, and how many different texts
    the group has. Texts whose sets of runs have a Jaccard similarity of at least `threshold` are linked, and groups are what links
    connect; a link is found with the chance of a common bucket (above), and none below the threshold is made.

    Words are lower-cased runs of letters, and texts of the same words are one text; null counts as empty, and texts without words
    are copies of each other. A document in several rows links their texts. Rows without an id take no part, and
    other columns are not looked at.
    """
    members, runs = _texts(docs)
    every = settle(runs.filter("size > 0").select("id", "size", F.posexplode("bands").alias("band", "value")))
    crowded = every.groupBy(*BUCKET).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    shared = settle(every.join(crowded, BUCKET, "left_semi").withColumn("alone", F.lit(True)))
    # The runs of texts that share no bucket are not needed.
    filled = settle(runs.select("id", "runs").join(shared.select("id").distinct(), "id", "left_semi"))
    first, compared = _with_distance(_hub_pairs(shared, 1), filled, "d1")
    open_now = first.drop("hub").withColumn("alone", F.col("d1") > 1 - threshold + SLACK)
    second, compared_too = _with_distance(_hub_pairs(open_now, 2), filled, "d2")
    near = lambda pairs: pairs.filter(F.col("similarity") >= threshold).select("a", "b")
    linked = near(compared).unionByName(near(compared_too))
    rest = _similar(_left_over(second.drop("hub"), groups(linked), threshold), filled)
    texts = members.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = settle(groups(texts.unionByName(linked).unionByName(near(rest))))
    own = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id")
    counts = own.groupBy("group_id").agg(F.count_distinct("id").alias("texts"))
    return found.withColumnRenamed("node", "doc_id").join(counts, "group_id").select("doc_id", "group_id", "texts")
