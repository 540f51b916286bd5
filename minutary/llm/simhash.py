"""Near copies by SimHash, searched through counts of bits per segment.

A fingerprint of 64 bits becomes 32 counts, one for each segment of two bits (0, 1 or 2).
The Manhattan distance of two such vectors is never above the Hamming distance of the
fingerprints, so fingerprints at `LINK_BITS` or fewer differing bits lie within that Manhattan
distance. The 32 axes fall into 6 groups; at distance 3 or less at least 3 groups agree in
full, so two such points share a cell of at least one of the 20 grids that keep 3 groups.
Points of a cell are compared: Manhattan bound first, then the exact bits.

Copies are one point. A cell with many different points is cut into chunks, every pair of
chunks is a task's work of its own, and what comes out is a spanning forest, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from minutary.llm import batches, components as cc, hashing
from minutary.session import settle

SEED = 42
SHINGLE = 3
LINK_BITS = 3
CHUNK = 128
TEXTS_IN_HAND = 64

_LOW = 0x5555555555555555
_GROUPS = [(0, 6), (6, 11), (11, 16), (16, 21), (21, 26), (26, 32)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _mask(first: int, last: int) -> int:
    return ((1 << 2 * last) - 1) ^ ((1 << 2 * first) - 1)


GRIDS = [_signed(sum(_mask(*_GROUPS[g]) for g in kept)) for kept in combinations(range(6), len(_GROUPS) - LINK_BITS)]


def majority_bits(hashes: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """One fingerprint per owner: a bit is set if it is in over half of the owner's hashes.

    Bytes of hashes are tallied by value, 256 tallies per byte, rather than bit by bit.
    """
    of_byte = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
    sizes = np.bincount(owner, minlength=owners)
    found = np.zeros(owners, dtype=np.uint64)
    for place in range(8):
        tally = np.bincount(owner * 256 + of_byte[:, place], minlength=owners * 256).reshape(owners, 256)
        on = (tally @ bits) * 2 > sizes[:, None]
        byte = np.packbits(on, axis=1, bitorder="little")[:, 0].astype(np.uint64)
        found |= byte << np.uint64(8 * place)
    return found


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, bits) for every row. No word (also null): zero bits."""

    def step(source):
        for batch in batches.pieces(source, TEXTS_IN_HAND, "text"):
            texts = [batches.words_of(text) for text in batch.column("text").to_pylist()]
            joined, starts, ends, owner = hashing.shingle_spans(texts, size)
            hashes = hashing.xxh64_spans(joined, starts, ends, SEED)
            kept = {name: batch.column(name) for name in ("doc_id", "text_hash")}
            yield kept | {"bits": majority_bits(hashes, owner, len(texts)).view(np.int64)}

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), batches.text_bytes().alias("text"))
    return batches.map_arrow(narrow, step, "doc_id long, text_hash long, bits long")


def segment_counts(bits: np.ndarray) -> np.ndarray:
    """32 counts of the set bits of two, packed in 64 bits, each in unary: 00, 01 or 11."""
    low = np.uint64(_LOW)
    even, odd = bits & low, (bits >> np.uint64(1)) & low
    return even | odd | ((even & odd) << np.uint64(1))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed count vectors: unary counts differ in |difference| bits."""
    return np.bitwise_count(a ^ b)


def _forest(nodes: np.ndarray, bits: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked within one small set: each node to the smallest of its part."""
    counts = segment_counts(bits)
    near = manhattan(counts[:, None], counts[None, :]) <= limit
    near &= np.bitwise_count(bits[:, None] ^ bits[None, :]) <= limit
    labels = nodes
    while True:
        lower = np.where(near, labels[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (lower == labels).all():
            break
        labels = lower
    moved = labels != nodes
    return nodes[moved], labels[moved]


def _block_links(source, limit: int = LINK_BITS):
    """Links inside each block of rows that share (cell, grid, first, second)."""
    keys = ["grid", "cell", "first", "second"]
    for rows in batches.whole_runs(source, keys):
        nodes, bits = rows["node"], rows["bits"].view(np.uint64)
        starts = batches.run_starts(*[rows[key] for key in keys])
        ends = np.append(starts[1:], len(nodes))
        pairs = starts[ends - starts == 2]
        a, b = bits[pairs], bits[pairs + 1]
        bound = manhattan(segment_counts(a), segment_counts(b)) <= limit
        linked = bound & (np.bitwise_count(a ^ b) <= limit)
        found = [(nodes[pairs][linked], nodes[pairs + 1][linked])]
        for start, end in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            found.append(_forest(nodes[start:end], bits[start:end], limit))
        yield {"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([x for _, x in found])}


def linked_points(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): enough links between different points (node, bits) to join all that are linked."""
    low = F.lit(_LOW).cast("long")
    even, odd = F.col("bits").bitwiseAND(low), F.shiftrightunsigned("bits", 1).bitwiseAND(low)
    counts = even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))
    grids = F.array(*[F.lit(mask).cast("long") for mask in GRIDS])
    cells = (
        points.withColumn("_counts", counts)
        .select("node", "bits", "_counts", F.posexplode(grids).alias("grid", "_mask"))
        .select("node", "bits", F.col("grid").cast("byte").alias("grid"), F.col("_counts").bitwiseAND(F.col("_mask")).alias("cell"))
    )
    shared = cells.groupBy("grid", "cell").count().filter("count > 1")
    chunks = F.ceil(F.col("count") / chunk).cast("int")
    own = F.pmod(F.hash("bits"), chunks)
    # A point meets every chunk of its cell once; (own, other) and (other, own) are one block.
    dealt = (
        cells.join(shared, ["grid", "cell"])
        .select("grid", "cell", "node", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("grid", "cell", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "node", "bits")
    )
    keys = ["grid", "cell", "first", "second"]
    blocks = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return batches.map_arrow(blocks, _block_links, "a long, b long")


def near_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_hash, bits, group, component_id) for every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included; `group` is one
    fingerprint of the component and its name where no row has a doc_id (component_id is null
    then). Rows that repeat a doc_id are each a text of their own, told apart by `text_hash`
    (Spark's xxhash64). Null, empty and wordless texts have fingerprint zero and are copies of
    each other. An empty table gives an empty one. Other columns are not looked at.
    """
    marked = settle(fingerprints(docs))
    points = marked.groupBy("bits").agg(F.min("doc_id").alias("doc_id"))
    links = linked_points(settle(points.select(F.col("bits").alias("node"), "bits")), chunk)
    parts = cc.components(links).select(F.col("node").alias("bits"), F.col("component").alias("group"))
    grouped = points.join(parts, "bits", "left").withColumn("group", F.coalesce("group", "bits"))
    lowest = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    named = grouped.select("bits", "group").join(lowest, "group")
    return marked.join(named, "bits").select("doc_id", "text_hash", "bits", "group", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, null last, and of its texts
    the one with the smallest hash; of equal rows one. The same columns."""
    marked = near_copies(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("kept")
    kept = marked.groupBy("group").agg(first).select(F.col("kept.doc_id").alias("_doc"), F.col("kept.text_hash").alias("_hash"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash"))
    return packed.join(kept, same, "left_semi").dropDuplicates(["_id", "_text"]).select("row.*")
