"""Key words and key sentences.

Every ranking is a `row_number() <= k` filter right above an aggregate, which Spark
cuts to k rows per meeting in each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from minutary.functions import text as tx
from minutary.operators import ordering, shaping

MEETING = ("meeting_id",)


def top_per(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first k rows of each key in the given order, numbered from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def sentence_terms(turns: DataFrame) -> DataFrame:
    """(meeting_id, turn, pos, term, n): the different words of each sentence and how often it
    has them. Written once, it serves weights, summaries, cosines and
    segments in place of the text."""
    each = shaping.sentences(turns).select(*_SENTENCE, F.explode(tx.word_list(F.col("sentence"))).alias("term"))
    return each.groupBy(*_SENTENCE, "term").agg(F.count("*").cast("int").alias("n"))


def turn_words(turns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(meeting_id, turn, `keep`, words): the words of each sentence of a turn, as an array of arrays in its own row. Written
    once, it serves counts, summaries, cosines and segments in place of the text; nothing is shuffled for it."""
    words = F.transform(tx.sentence_list(F.col("text")), tx.word_list)
    return turns.select("meeting_id", "turn", *keep, words.alias("words"))


def each_word(words: DataFrame) -> DataFrame:
    """(meeting_id, turn, pos, term, n) for each word of a table made by `turn_words`; n is 1."""
    said = words.select("meeting_id", "turn", F.posexplode("words").alias("pos", "_said"))
    return said.select(*_SENTENCE, F.explode("_said").alias("term"), F.lit(1).alias("n"))


def term_weights(turns: DataFrame, n: int = 1, keys: tuple[str, ...] = MEETING, words: DataFrame | None = None) -> DataFrame:
    """Count x ln(meetings / meetings with the term), for each term of each meeting.

    `words` (the columns of `keys`, term and n), such as `sentence_terms` or `topics.segment_terms`, spares the text a reading.

    A word used in every meeting is a hot key of the join. It is one row on the small
    side and split on the large one by adaptive execution. Meetings are counted from the
    turns, so one without words counts too.
    """
    if words is not None:
        phrases = words.select(*keys, "term", "n")
    elif n == 1:
        phrases = turns.select(*keys, F.explode(tx.word_list(F.col("text"))).alias("term"))
    else:
        split = turns.select(*keys, tx.word_list(F.col("text")).alias("_words"))
        phrases = split.select(*keys, F.explode(tx.phrase_list(F.col("_words"), n)).alias("term"))
    uses = F.count(F.lit(1)) if words is None else F.sum("n")
    counts = phrases.groupBy(*keys, "term").agg(uses.alias("uses"))
    # Counted by way of `uses`, so that both sides need the same of `counts` and Spark splits and
    # shuffles the text once.
    spread = counts.groupBy("term").agg(F.sum((F.col("uses") > 0).cast("long")).alias("meetings"))
    # As a struct, so that a null key counts as one.
    every = turns.agg(F.count_distinct(F.struct(*keys))).scalar()
    weight = tx.rounded(F.col("uses") * F.ln(every / F.col("meetings")))
    return counts.join(spread, "term").select(*keys, "term", "uses", weight.alias("weight"))


def key_terms(turns: DataFrame, k: int, n: int = 1, keys: tuple[str, ...] = MEETING, weights: DataFrame | None = None) -> DataFrame:
    """Top k words, or phrases of n words, per meeting; ties alphabetical."""
    weights = term_weights(turns, n, keys) if weights is None else weights
    return top_per(weights, list(keys), [F.desc("weight"), F.col("term")], k, "rank")


def _sentence_words(turns: DataFrame) -> DataFrame:
    """Sentences with their words, splitting each turn in its own row."""
    return shaping.sentences(turns).withColumn("words", tx.word_list(F.col("sentence")))


def _each(words: str, at_least: int) -> Column:
    """One row per word of a sentence that has enough of them. Exploding an expression
    rather than the column keeps Spark from adding a filter that splits it again."""
    return F.explode(F.when(F.size(words) >= at_least, F.col(words)))


_SENTENCE = ["meeting_id", "turn", "pos"]


def with_sentence(best: DataFrame, turns: DataFrame) -> DataFrame:
    """Fetch the text of the few sentences that were picked; until here only ids and
    words are shuffled. If several turns have one key, the sentence is the first in
    order of those that they have at that place."""
    texts = turns.select("meeting_id", "turn", "text")
    sentence = F.get(tx.sentence_list(F.col("text")), F.col("pos"))
    found = ordering.join_on(best, texts, ["meeting_id", "turn"]).withColumn("sentence", sentence)
    return found.groupBy(*best.columns).agg(F.min("sentence").alias("sentence"))


def key_sentences(
    turns: DataFrame,
    k: int,
    min_words: int = 3,
    weights: DataFrame | None = None,
    scorer=None,
    words: DataFrame | None = None,
) -> DataFrame:
    """Extractive summary: the k sentences of each meeting with the highest mean word
    weight. `place` is the rank; sort by turn and pos for reading order.

    `scorer`, a vectorized function of the sentence, replaces the weight: see
    `functions.hooks.sentence_scorer`. `words`, from `turn_words`, spares the text a reading.
    """
    found = _sentence_words(turns)
    if scorer is not None:
        scored = found.filter(F.size("words") >= min_words).select(*_SENTENCE, tx.rounded(scorer(F.col("sentence"))).alias("score"))
    else:
        weights = term_weights(turns) if weights is None else weights
        each = sentence_terms(turns) if words is None else each_word(words)
        weighed = ordering.join_on(each, weights.select("meeting_id", "term", "weight"), ["meeting_id", "term"])
        # Weights have six places, so millionths add up exactly in any order.
        millionths = F.sum(F.round(F.col("weight") * 1_000_000).cast("long") * F.col("n")) / F.sum("n")
        sized = weighed.groupBy(*_SENTENCE).agg((F.round(millionths) / 1_000_000).alias("score"), F.sum("n").alias("_words"))
        scored = sized.filter(F.col("_words") >= min_words).drop("_words")
    best = top_per(scored, ["meeting_id"], [F.desc("score"), F.col("turn"), F.col("pos")], k, "place")
    return with_sentence(best, turns)


def _sum_of(whole: Column) -> Column:
    """Sum of whole numbers as a double, from two sums of which neither leaves a long for some
    10^12 rows."""
    million = F.lit(1_000_000)
    return F.sum(F.floor(whole / million)).cast("double") * million + F.sum(F.pmod(whole, million)).cast("double")


def central_sentences(turns: DataFrame, k: int, min_words: int = 1) -> DataFrame:
    """Another summary: the k sentences most like the rest of their meeting, by mean
    cosine of word sets with every other sentence (degree centrality with similarities
    as weights, after Erkan and Radev 2004).

    The sum of a sentence's cosines with all sentences is its product with the sum of
    all their unit vectors. That sum is one number per word of the meeting, so no two
    sentences are ever paired.
    """
    found = _sentence_words(turns).select(*_SENTENCE, F.array_distinct("words").alias("words"))
    unit = 1 / F.sqrt(F.size("words"))
    each = found.select(*_SENTENCE, unit.alias("unit"), _each("words", min_words).alias("word"))
    # Whole numbers add up the same in any order.
    unit_parts = F.round(F.col("unit") * 1_000_000_000_000).cast("long")
    pull = each.groupBy("meeting_id", "word").agg((_sum_of(unit_parts) / 1_000_000_000_000).alias("pull"))
    sizes = found.groupBy("meeting_id").agg(F.count_if(F.size("words") >= min_words).alias("_sentences"))
    part = F.round(F.col("unit") * F.col("pull") * 1_000_000_000).cast("long")
    summed = ordering.join_on(each, pull, ["meeting_id", "word"]).groupBy(*_SENTENCE).agg(
        (_sum_of(part) / 1_000_000_000).alias("_with_itself")
    )
    others = F.col("_sentences") - 1
    mean = F.when(others > 0, (F.col("_with_itself") - 1) / others).otherwise(F.lit(0.0))
    scored = ordering.join_on(summed, sizes, ["meeting_id"]).select(*_SENTENCE, tx.rounded(mean).alias("centrality"))
    best = top_per(scored, ["meeting_id"], [F.desc("centrality"), F.col("turn"), F.col("pos")], k, "place")
    return with_sentence(best, turns)
