"""Benchmark items found inside documents, by MinHash containment search.

Items are partitioned by size. An item of n different shingles at containment 0.8 lacks at most
n - ceil(0.8 n) of them in the document, so of its smallest n - ceil(0.8 n) + 1 MinHash
values (a bottom-k sketch, as long as the largest size of its partition needs) the document
holds at least one: the search misses nothing. What it finds is verified by counting the
item's shingles, as text, in the document.

A document of any length is read once. A filter of fixed size says which of its shingles may be
in an item at all; only those leave the task, so the document itself is never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from minutary.llm import batches, hashing
from minutary.session import settle

SHINGLE = 5
CONTAINMENT = 0.8
# Two megabytes at any number of items. More items than it suits let more shingles
# through to the exact join, none fewer.
FILTER_BITS = 1 << 24


def needed(shingles: int, containment: float = CONTAINMENT) -> int:
    """Smallest number of shingles found that makes `containment`."""
    return math.ceil(round(containment * shingles, 9))


def sketch_length(shingles: int, containment: float = CONTAINMENT) -> int:
    """MinHash values for the partition of sizes 2^i to 2^(i+1) - 1 that holds `shingles`."""
    largest = (1 << shingles.bit_length()) - 1
    return largest - needed(largest, containment) + 1


def shingles_of(text: bytes, size: int = SHINGLE) -> set[bytes]:
    """Different runs of `size` words; the whole text if it has fewer, nothing without words."""
    words = batches.words_of(text)
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[at : at + size]) for at in range(len(words) - size + 1)}


def item_shingles(items: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """Each item's shingles, whether they are in its sketch, and their places in the filter."""

    def step(source):
        for batch in batches.pieces(source):
            columns = [batch.column(name).to_pylist() for name in ("item_id", "item_hash", "text")]
            for item_id, item_hash, text in zip(*columns):
                found = sorted(shingles_of(text, size), key=lambda each: (xxhash.xxh64_intdigest(each), each))
                if not found:
                    continue
                total = len(found)
                joined = b"".join(found)
                ends = np.cumsum([len(each) for each in found])
                starts = ends - [len(each) for each in found]
                slots, seconds = filter_places(hashing.rolling_hashes(joined, starts, ends))
                yield {
                    "item_id": [item_id] * total,
                    "item_hash": [item_hash] * total,
                    "shingle": found,
                    "words": [found[0].count(b" ") + 1] * total,
                    "shingles": [total] * total,
                    "needed": [needed(total, containment)] * total,
                    "sketched": np.arange(total) < sketch_length(total, containment),
                    "slot": slots.astype(np.int64),
                    "second": seconds.astype(np.int64),
                }

    narrow = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_hash"), batches.text_bytes().alias("text")
    )
    schema = "item_id long, item_hash long, shingle binary, words int, shingles int, needed int, sketched boolean, slot long, second long"
    return batches.map_arrow(narrow, step, schema)


def filter_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = FILTER_BITS.bit_length() - 1
    return hashes >> np.uint64(64 - width), (hashes >> np.uint64(8)) & np.uint64(FILTER_BITS - 1)


def shingle_filter(shingles: DataFrame) -> np.ndarray:
    """FILTER_BITS flags as bytes of eight. At most FILTER_BITS / 64 rows reach the driver."""
    slots = shingles.select(F.explode(F.array("slot", "second")).alias("slot"))
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    words = slots.groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    flags = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in words.collect():
        flags[row.word] = row.bits
    return flags.view(np.uint8)


def document_hits(docs: DataFrame, flags: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, text_hash, shingle), each once per row of `docs`, for runs of as many words as one of
    `sizes` says that pass the filter."""

    def passes(slots: np.ndarray) -> np.ndarray:
        return (flags[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def step(source):
        for batch in batches.pieces(source, text="text"):
            texts = [batches.words_of(text) for text in batch.column("text").to_pylist()]
            lengths = np.array([len(words) for words in texts], dtype=np.int64)
            found: dict[tuple[int, bytes], None] = {}
            for size in sizes:
                joined, starts, ends, owner = hashing.shingle_spans(texts, size)
                slots, seconds = filter_places(hashing.rolling_hashes(joined, starts, ends))
                hits = np.flatnonzero(passes(slots))
                hits = hits[passes(seconds[hits]) & (lengths[owner[hits]] >= size)]
                found |= dict.fromkeys((int(owner[at]), joined[starts[at] : ends[at]]) for at in hits)
            owners = np.array([each for each, _ in found], dtype=np.int64)
            yield {
                "doc_id": batch.column("doc_id").take(owners),
                "text_hash": batch.column("text_hash").take(owners),
                "shingle": [shingle for _, shingle in found],
            }

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), batches.text_bytes().alias("text"))
    return batches.map_arrow(narrow, step, "doc_id long, text_hash long, shingle binary")


def leaks(docs: DataFrame, items: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_hash, item_id, shingles, found, containment): items held by documents.

    Words are as in `batches.words_of`. An item of fewer than `size` words is one shingle of all its words, and
    a document holds it where these follow each other, whatever stands around them. Null, empty and wordless
    texts hold nothing and are held by nothing. Repeated rows of `docs` give one row (equal texts) or one
    per text; `text_hash` is Spark's xxhash64 of it.
    Rows of `items` with one item_id and different texts are different items. Null ids are ids
    of their own. Empty tables give an empty one.
    """
    parts = settle(item_shingles(items, size, containment).distinct())
    # At most `size` numbers: only lengths that items have are sought in documents.
    sizes = sorted(row.words for row in parts.select("words").distinct().collect())
    hits = settle(document_hits(docs, shingle_filter(parts), sizes).distinct())
    d, p = hits.alias("d"), parts.alias("p")
    candidates = (
        d.join(p.filter("sketched"), "shingle").select("d.doc_id", "d.text_hash", "p.item_id", "p.item_hash").distinct()
    )
    same_document = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash"))
    same_item = F.col("p.item_id").eqNullSafe(F.col("c.item_id")) & (F.col("p.item_hash") == F.col("c.item_hash"))
    held = (
        candidates.alias("c")
        .join(d, same_document)
        .join(p, same_item & (F.col("p.shingle") == F.col("d.shingle")))
        .groupBy("c.doc_id", "c.text_hash", "c.item_id", "p.item_hash", "p.shingles", "p.needed")
        .agg(F.count("*").alias("found"))
        .filter("found >= needed")
    )
    share = (F.col("found") / F.col("shingles")).alias("containment")
    return held.select("doc_id", "text_hash", "item_id", "shingles", "found", share)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item; the same columns."""
    dirty = leaks(docs, items).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    packed = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64("row.text") == F.col("_hash"))
    return packed.join(dirty, same, "left_anti").select("row.*")
