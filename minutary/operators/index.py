"""A kept index of words: search without reading the text again.

    postings/segment=<id>/bucket=<n>/   a row per word and block of at most 128 turns, in order of impact
    segments/                           a row per finished addition: its turns and their words

An addition is a segment of its own, and nothing that was written is touched. Within a segment the turns of
a word stand in falling order of what they can score (uses, then shortness), so blocks with higher numbers score less, and a
search reads those up to a number only. A segment counts once its row is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from minutary.functions import text as tx
from minutary.operators.search import B, K1, asked_words
from minutary.operators.terms import top_per

BUCKETS = 64
BLOCK_TURNS = 128
# More than rounding can move a score.
SLACK = 1e-5

_BLOCK = "term string, block long, n int, most_uses int, least_words int, meetings array<long>, turns array<long>, uses array<int>, words array<int>, bucket int"
_SEGMENTS = "segment string, turns long, texts long, words long"


def _bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows into blocks of one word; numbers grow with the order over all partitions."""
    number = TaskContext.get().partitionId() << 32
    held: pa.Table | None = None

    def cut(table: pa.Table, last: bool) -> tuple[list[tuple[int, int]], int]:
        terms = np.array(table.column("term").to_pylist(), dtype=object)
        starts = [0, *(np.flatnonzero(terms[1:] != terms[:-1]) + 1), len(terms)]
        pieces = [(at, min(at + BLOCK_TURNS, end)) for start, end in zip(starts, starts[1:]) for at in range(start, end, BLOCK_TURNS)]
        # The last one may go on in the next batch.
        return (pieces, len(terms)) if last else (pieces[:-1], pieces[-1][0])

    def rows(table: pa.Table, pieces: list[tuple[int, int]]) -> pa.RecordBatch:
        nonlocal number
        ends = pa.array(np.append(0, np.cumsum([end - start for start, end in pieces])).astype(np.int32))
        size = pieces[-1][1]
        lists = [pa.ListArray.from_arrays(ends, table.column(name).slice(0, size).combine_chunks()) for name in ("meeting_id", "turn", "uses", "words")]
        firsts = [start for start, _ in pieces]
        numbers = np.arange(number, number + len(pieces))
        number += len(pieces)
        used, long = table.column("uses").to_numpy()[:size], table.column("words").to_numpy()[:size]
        columns = [
            table.column("term").take(firsts).combine_chunks(), pa.array(numbers), pa.array([end - start for start, end in pieces], pa.int32()),
            pa.array(np.maximum.reduceat(used, firsts)), pa.array(np.minimum.reduceat(long, firsts)), *lists,
            table.column("bucket").take(firsts).combine_chunks(),
        ]
        return pa.RecordBatch.from_arrays(columns, [each.split()[0] for each in _BLOCK.split(", ")])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if table.num_rows:
            pieces, done = cut(table, last=False)
            if pieces:
                yield rows(table, pieces)
            held = table.slice(done)
    if held is not None and held.num_rows:
        yield rows(held, cut(held, last=True)[0])


def add_to_index(turns: DataFrame, path: str) -> None:
    """Add turns, none of which the index has, as a new segment. A turn is known by meeting and number;
    rows of the same key are one turn with the words of all. Without turns nothing is added.

    A word that a third of all turns use is spread over tasks by range.
    """
    spark, segment = turns.sparkSession, uuid.uuid4().hex
    words = turns.select("meeting_id", "turn", tx.word_list(F.col("text")).alias("_words"))
    lengths = words.groupBy("meeting_id", "turn").agg(F.sum(F.size("_words")).cast("int").alias("words"))
    # A turn without a text counts as a turn, not in the mean length.
    totals = lengths.agg(F.count("*").alias("turns"), F.count("words").alias("texts"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    if not totals.turns:
        return
    each = words.select("meeting_id", "turn", F.size("_words").alias("_n"), F.explode("_words").alias("term"))
    used = each.groupBy("meeting_id", "turn", "term").agg(F.count("*").cast("int").alias("uses"))
    same = F.col("turn").eqNullSafe(F.col("_turn")) & F.col("meeting_id").eqNullSafe(F.col("_meeting"))
    sized = used.join(lengths.select(F.col("meeting_id").alias("_meeting"), F.col("turn").alias("_turn"), "words"), same)
    rows = sized.select(_bucket(F.col("term")).alias("bucket"), "term", "uses", "words", "meeting_id", "turn")
    order = ["bucket", "term", F.desc("uses"), "words", "meeting_id", "turn"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_blocks, _BLOCK).write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    row = spark.createDataFrame([(segment, totals.turns, totals.texts, totals.words)], _SEGMENTS)
    row.coalesce(1).write.mode("append").parquet(f"{path}/segments")


class Search:
    """One question to an index: which blocks can matter, and their postings."""

    def __init__(self, spark: SparkSession, path: str, query: str | list[str], k: int):
        self.terms, self.k = asked_words(query), k
        segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
        self.segments = [row.segment for row in segments.select("segment").collect()]
        sums = segments.agg(F.sum("turns").alias("turns"), F.sum("texts").alias("texts"), F.sum("words").alias("words")).first()
        self.turns, self.mean_words = sums.turns, sums.words / max(sums.texts, 1)
        buckets = [row[0] for row in spark.createDataFrame([(term,) for term in self.terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
        every = spark.read.schema(f"{_BLOCK}, segment string").option("basePath", f"{path}/postings").parquet(
            *[f"{path}/postings/segment={segment}" for segment in self.segments]
        )
        self.postings = every.filter(F.col("bucket").isin(buckets) & F.col("term").isin(self.terms))
        self.headers = self.postings.select("segment", "term", "block", "n", "most_uses", "least_words")
        counts = {row.term: row.n for row in self.headers.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        self.found = [term for term in self.terms if term in counts]
        self.rarity = {term: float(np.log((self.turns - n + 0.5) / (n + 0.5) + 1)) for term, n in counts.items()}

    def _score(self, uses: Column, words: Column) -> Column:
        """Of one word in one turn."""
        rarity = F.lit(0.0)
        for term in self.found:
            rarity = F.when(F.col("term") == term, self.rarity[term]).otherwise(rarity)
        return rarity * uses * (K1 + 1) / (uses + K1 * (1 - B + B * words / self.mean_words))

    def _postings(self, blocks: Column) -> DataFrame:
        listed = F.arrays_zip("meetings", "turns", "uses", "words")
        rows = self.postings.filter(blocks).select("term", F.inline(listed))
        return rows.select("term", F.col("meetings").alias("meeting_id"), F.col("turns").alias("turn"), self._score(F.col("uses"), F.col("words")).alias("part"))

    def cutoffs(self) -> dict[str, int]:
        """The last block of each word that can be part of the answer.

        The best blocks of each word alone give k turns a score that the answer has to reach. A block whose best turn falls short
        of it, even with the most that the other words can add, holds no turn of the answer.
        """
        bound = self.headers.withColumn("bound", self._score(F.col("most_uses"), F.col("least_words")))
        heads = top_per(bound, ["segment", "term"], [F.col("block")], -(-self.k // BLOCK_TURNS), "_at").select("term", "block").collect()
        if not heads:
            return {}
        best = self._postings(F.col("block").isin([row.block for row in heads]))
        ranked = top_per(best, ["term"], [F.desc("part")], self.k, "_at").filter(F.col("_at") == self.k)
        least = ranked.agg(F.max("part")).first()[0] or 0.0
        most = {row.term: row.most for row in bound.groupBy("term").agg(F.max("bound").alias("most")).collect()}
        others = F.lit(0.0)
        for term in self.found:
            others = F.when(F.col("term") == term, sum(most.values()) - most[term]).otherwise(others)
        kept = bound.filter(F.col("bound") + others >= least - SLACK)
        return {row.term: row["last"] for row in kept.groupBy("term").agg(F.max("block").alias("last")).collect()}

    def answer(self) -> DataFrame:
        cut = F.lit(False)
        for term, last in self.cutoffs().items():
            cut = cut | ((F.col("term") == term) & (F.col("block") <= last))
        rows = self._postings(cut)
        parts = [F.coalesce(F.sum(F.when(F.col("term") == term, F.col("part"))), F.lit(0.0)).alias(f"_{at}") for at, term in enumerate(self.found)]
        score = F.lit(0.0)
        for at in range(len(parts)):
            score = score + F.col(f"_{at}")
        summed = rows.groupBy("meeting_id", "turn").agg(*(parts or [F.lit(0.0).alias("_none")]))
        return summed.select("meeting_id", "turn", tx.rounded(score).alias("score")).orderBy(F.desc("score"), "meeting_id", "turn").limit(self.k)


def search_index(spark: SparkSession, path: str, query: str | list[str], k: int) -> DataFrame:
    """The k turns of the index at `path` that match best by BM25, ties by key: the rows of `search.search_turns`.

    Read are the buckets of the asked words, their rows, and of these the blocks that can be part of the answer.
    """
    return Search(spark, path, query, k).answer()
