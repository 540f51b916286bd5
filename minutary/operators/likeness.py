"""How many sentences of a meeting are like a sentence: degrees, without a list of pairs.

A set-similarity join with prefix filter. The words of a sentence stand in order of rarity in its meeting. Two sentences of
Jaccard similarity t or more have one of their first words in common, as many words as are left if all but the fewest that
they must share are taken away. Sentences meet under such words, and a pair counts under the rarest of its common words only.
Sentences under one word are cut into chunks, and pairs of chunks are compared as matrices, which give counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from minutary.functions import text as tx
from minutary.operators import ordering, shaping
from minutary.operators.terms import top_per, with_sentence
from minutary.session import settle

THRESHOLD = 0.1
CHUNK_ROWS = 256
WORDS_AT_ONCE = 1 << 13
# Fewer rows than this under a word are compared together with other words' rows, without a matrix.
FEW_ROWS = 32
_SENTENCE = ["meeting_id", "turn", "pos"]


def _sets(turns: DataFrame) -> DataFrame:
    """Sentences with the set of their words and an id for it that holds in the meeting."""
    found = shaping.sentences(turns).select(*_SENTENCE, F.array_sort(F.array_distinct(tx.word_list(F.col("sentence")))).alias("words"))
    meeting = F.coalesce(F.col("meeting_id").cast("string"), F.lit("-"))
    return found.withColumn("set_id", F.unhex(F.md5(F.concat_ws(" ", meeting, F.array_join("words", " ")))))


def _first_words(sets: DataFrame, threshold: float) -> DataFrame:
    """A row per different set and word under which it is looked for: (meeting_id, word, set_id, weight, rarity, words)."""
    weighed = sets.filter(F.size("words") > 0).groupBy("meeting_id", "set_id").agg(F.count("*").alias("weight"), F.first("words").alias("words"))
    each = weighed.select("meeting_id", "set_id", "weight", F.explode("words").alias("word"))
    each = each.select("meeting_id", "set_id", "weight", F.xxhash64("word").alias("word"))
    counts = each.groupBy("meeting_id", "word").agg(F.count("*").alias("rarity"))
    placed = ordering.join_on(each, counts, ["meeting_id", "word"])
    ranked = placed.groupBy("meeting_id", "set_id", "weight").agg(F.array_sort(F.collect_list(F.struct("rarity", "word"))).alias("_ranked"))
    kept = F.size("_ranked") - F.ceil(F.size("_ranked") * F.lit(threshold) - 1e-9).cast("int") + 1
    first = F.slice("_ranked", F.lit(1), F.least(F.size("_ranked"), kept))
    return ranked.select(
        "meeting_id", "set_id", "weight", F.col("_ranked.rarity").alias("rarities"), F.col("_ranked.word").alias("words"),
        F.inline(first),
    )


def _chunk_pairs(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Each row with every pair of chunks of its word that its own chunk is in, in order of pairs."""
    sizes = rows.groupBy("meeting_id", "word").agg((F.ceil(F.count("*") / chunk_rows)).cast("int").alias("_chunks"), F.count("*").alias("_n"))
    crowded = sizes.filter("_n > 1").drop("_n")
    dealt = ordering.join_on(rows, crowded, ["meeting_id", "word"]).withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("_chunks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    pair = F.concat_ws(
        "|", F.coalesce(F.col("meeting_id").cast("string"), F.lit("-")), "word", F.least("chunk", "other"), F.greatest("chunk", "other")
    )
    keyed = other.select(pair.alias("pair"), (F.col("chunk") == F.col("other")).alias("within"), "chunk", "set_id", "weight", "rarities", "words", "rarity", "word")
    return keyed.repartition("pair").sortWithinPartitions("pair", "chunk")


def _overlaps(owner: np.ndarray, word: np.ndarray, rows: int) -> np.ndarray:
    """How many words every two rows share."""
    found = np.zeros((rows, rows), dtype=np.float32)
    _, column = np.unique(word, return_inverse=True)
    for start in range(0, int(column.max(initial=-1)) + 1, WORDS_AT_ONCE):
        own = (column >= start) & (column < start + WORDS_AT_ONCE)
        block = np.zeros((rows, min(WORDS_AT_ONCE, int(column.max()) + 1 - start)), dtype=np.float32)
        block[owner[own], column[own] - start] = 1
        found += block @ block.T
    return found.astype(np.int64)


def _degrees(run: pa.Table, threshold: float) -> np.ndarray:
    """For each row of a pair of chunks, the weight of the rows of the other (or same) chunk that are like it and whose
    rarest common word is the one under which they meet."""
    sizes = run.column("words").combine_chunks().value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(run.num_rows), sizes)
    word = run.column("words").combine_chunks().flatten().to_numpy()
    rarity = run.column("rarities").combine_chunks().flatten().to_numpy()
    own_rarity, own_word = run.column("rarity")[0].as_py(), run.column("word")[0].as_py()
    common = _overlaps(owner, word, run.num_rows)
    rarer = (rarity < own_rarity) | ((rarity == own_rarity) & (word < own_word))
    earlier = _overlaps(owner[rarer], word[rarer], run.num_rows)
    like = (earlier == 0) & (common / (sizes[:, None] + sizes[None, :] - common) >= threshold)
    chunk = run.column("chunk").to_numpy()
    if run.column("within")[0].as_py():
        np.fill_diagonal(like, False)
    else:
        like &= chunk[:, None] != chunk[None, :]
    return like @ run.column("weight").to_numpy()


def _few_degrees(run: pa.Table, sizes_of: np.ndarray, threshold: float) -> np.ndarray:
    """What `_degrees` gives, for runs of few rows, `sizes_of` each, one after the other: every two rows of a run have a place in
    one array, and each word that they share adds to it."""
    group = np.repeat(np.arange(len(sizes_of)), sizes_of)
    starts, rows = np.cumsum(sizes_of) - sizes_of, np.arange(len(group))
    within_group, bases = rows - starts[group], np.cumsum(sizes_of**2) - sizes_of**2
    sizes = run.column("words").combine_chunks().value_lengths().to_numpy().astype(np.int64)
    owner = np.repeat(rows, sizes)
    word = run.column("words").combine_chunks().flatten().to_numpy()
    rarity = run.column("rarities").combine_chunks().flatten().to_numpy()
    own_rarity, own_word = run.column("rarity").to_numpy()[owner], run.column("word").to_numpy()[owner]
    rarer = (rarity < own_rarity) | ((rarity == own_rarity) & (word < own_word))
    order = np.lexsort((word, group[owner]))
    owner, word, rarer = owner[order], word[order], rarer[order]
    opens = np.ones(len(owner), dtype=bool)
    opens[1:] = (word[1:] != word[:-1]) | (group[owner[1:]] != group[owner[:-1]])
    at = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    many = np.diff(np.append(first, len(owner)))
    # Each entry with all entries of its word and run.
    left = np.repeat(np.arange(len(owner)), many[at])
    right = np.arange(len(left)) - np.repeat(np.cumsum(many[at]) - many[at], many[at]) + first[at[left]]
    a, b = owner[left], owner[right]
    pair = bases[group[a]] + within_group[a] * sizes_of[group[a]] + within_group[b]
    places = int((sizes_of**2).sum())
    common = np.bincount(pair, minlength=places)
    earlier = np.bincount(pair[rarer[left]], minlength=places)
    row = np.repeat(rows, sizes_of[group])
    other = np.arange(places) - bases[group[row]] - within_group[row] * sizes_of[group[row]] + starts[group[row]]
    like = (earlier == 0) & (common / (sizes[row] + sizes[other] - common) >= threshold)
    chunk = run.column("chunk").to_numpy()
    like &= np.where(run.column("within").to_numpy()[row], row != other, chunk[row] != chunk[other])
    found = np.zeros(len(rows), dtype=np.int64)
    np.add.at(found, row[like], run.column("weight").to_numpy()[other[like]])
    return found


def _all_degrees(table: pa.Table, cuts: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The degrees of all runs of a table, which end at `cuts`."""
    sizes = np.diff(np.append(0, cuts))
    few = np.repeat(sizes < FEW_ROWS, sizes)
    parts = [(table.slice(end - size, size), None) for end, size in zip(cuts, sizes) if size >= FEW_ROWS]
    if few.any():
        parts.append((table.filter(pa.array(few)), sizes[sizes < FEW_ROWS]))
    for run, of in parts:
        degrees = _degrees(run, threshold) if of is None else _few_degrees(run, of, threshold)
        yield pa.RecordBatch.from_arrays([run.column("set_id").combine_chunks(), pa.array(degrees, pa.int64())], ["set_id", "degree"])


def sentence_degrees(turns: DataFrame, threshold: float = THRESHOLD, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(meeting_id, turn, pos, degree): how many other sentences of the meeting have word sets of a Jaccard
    similarity of at least `threshold`, which is above 0.

    Sentences of the same words are compared once and counted as often as they occur. A sentence without words
    has degree 0. Turns without a meeting are one meeting.
    """
    sets = settle(_sets(turns))
    pairs = _chunk_pairs(_first_words(sets, threshold), chunk_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            keys = table.column("pair").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if len(cuts):
                yield from _all_degrees(table.slice(0, cuts[-1]), cuts, threshold)
                table = table.slice(cuts[-1])
            held = table
        if held is not None and held.num_rows:
            yield from _all_degrees(held, np.array([held.num_rows]), threshold)

    degrees = pairs.mapInArrow(run, "set_id binary, degree long").groupBy("set_id").agg(F.sum("degree").alias("degree"))
    alike = sets.groupBy("set_id").agg(F.count("*").alias("_same"))
    summed = alike.join(degrees, "set_id", "left")
    degree = F.when(F.size("words") > 0, F.col("_same") - 1 + F.coalesce("degree", F.lit(0))).otherwise(F.lit(0))
    return sets.join(summed, "set_id").select(*_SENTENCE, degree.cast("long").alias("degree"))


def linked_sentences(turns: DataFrame, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """A summary after LexRank's degree form (Erkan and Radev 2004): the k sentences of each meeting with the highest
    degree, ties in reading order. `place` is the rank."""
    order: list[Column] = [F.desc("degree"), F.col("turn"), F.col("pos")]
    return with_sentence(top_per(sentence_degrees(turns, threshold), ["meeting_id"], order, k, "place"), turns)
