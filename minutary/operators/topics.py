"""Where the talk changes topic, and the stretches in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minutary.functions import text as tx
from minutary.operators import ordering, terms
from minutary.session import settle


def turn_cosines(
    turns: DataFrame, block_turns: int = ordering.TURNS_PER_BLOCK, words: DataFrame | None = None
) -> DataFrame:
    """Cosine of word counts between each turn and the one before it.

    Each word goes into two sums: its turn as the later one of a pair, and as the
    earlier one. Grouping by pair and word then holds both counts side by side, so
    turns are not joined to each other. A blank word marks both ends of a pair. Words travel
    as an array per turn and are counted where the pair is. `words` is from `terms.turn_words`.

    Which turn comes next follows from the keys alone, each once; a repeated key is one turn with the
    words of all its rows. Turns without a key are in no pair.
    """
    known = turns.filter("meeting_id IS NOT NULL AND turn IS NOT NULL")
    keys = known.select("meeting_id", "turn").distinct()
    following = ordering.with_next(ordering.block_by_turn(keys, block_turns), ["meeting_id"], ["turn"], {"_next": "turn"})
    none = F.array().cast("array<string>")
    said = F.concat(F.coalesce(F.flatten("words"), none), F.array(F.lit(""))).alias("_said")
    spoken = (terms.turn_words(known) if words is None else words).select("meeting_id", "turn", said)
    rows = spoken.join(following.select("meeting_id", "turn", "_next"), ["meeting_id", "turn"])
    pair = F.array(
        F.struct(F.col("turn").alias("at"), F.lit(1).alias("_late"), F.lit(0).alias("_early")),
        F.struct(F.col("_next").alias("at"), F.lit(0).alias("_late"), F.lit(1).alias("_early")),
    )
    sides = rows.select("meeting_id", "_said", F.inline(pair)).filter("at IS NOT NULL").repartition("meeting_id", "at")
    each = sides.select("meeting_id", "at", "_late", "_early", F.explode("_said").alias("word"))
    counts = each.groupBy("meeting_id", "at", "word").agg(F.sum("_late").alias("a"), F.sum("_early").alias("b"))
    real = F.col("word") != ""
    sums = counts.groupBy("meeting_id", "at").agg(
        F.sum(F.when(real, F.col("a") * F.col("b")).otherwise(0)).alias("ab"),
        F.sum(F.when(real, F.col("a") * F.col("a")).otherwise(0)).alias("aa"),
        F.sum(F.when(real, F.col("b") * F.col("b")).otherwise(0)).alias("bb"),
        F.sum(F.when(real, 0).otherwise(F.col("a") * F.col("b"))).alias("_pairs"),
    )
    size = F.sqrt(F.col("aa").cast("double")) * F.sqrt(F.col("bb").cast("double"))
    cosine = F.when(size > 0, tx.rounded(F.col("ab") / size)).otherwise(F.lit(0.0))
    return sums.filter("_pairs > 0").select("meeting_id", F.col("at").alias("turn"), cosine.alias("cosine"))


def topic_shifts(
    turns: DataFrame, k: int, block_turns: int = ordering.TURNS_PER_BLOCK, words: DataFrame | None = None
) -> DataFrame:
    """The k turns of each meeting least like the one before (after TextTiling, Hearst
    1997); ties by turn."""
    cosines = turn_cosines(turns, block_turns, words)
    return terms.top_per(cosines, ["meeting_id"], [F.col("cosine"), F.col("turn")], k, "rank")


def number_segments(turns: DataFrame, shifts: DataFrame, block_turns: int = ordering.TURNS_PER_BLOCK) -> DataFrame:
    """Add `segment`, from 0: how many shifts lie at or before the turn.

    Shifts are merged into the order of turns and counted there, on keys alone.
    """
    marks = shifts.select("meeting_id", "turn").withColumn("_shift", F.lit(1))
    spoken = turns.select("meeting_id", "turn").distinct().withColumn("_shift", F.lit(0))
    both = ordering.block_by_turn(spoken.unionByName(marks), block_turns)
    both = ordering.carry(both, ["meeting_id"], {"_before": (F.sum("_shift"), "sum")})
    window = ordering.so_far(["meeting_id"], [F.col("turn"), F.desc("_shift")])
    numbered = both.withColumn("segment", F.sum("_shift").over(window) + F.coalesce("_before", F.lit(0)))
    placed = numbered.filter("_shift = 0").select("meeting_id", "turn", "segment")
    return ordering.join_on(turns, placed, ["meeting_id", "turn"])


def segment_terms(numbered: DataFrame, words: DataFrame) -> DataFrame:
    """(meeting_id, segment, term, n): how often each stretch has each word. `numbered` is from `number_segments`,
    `words` from `terms.turn_words`, of which one row meets each turn."""
    places = numbered.select("meeting_id", "turn", "segment").distinct()
    spoken = ordering.join_on(words.select("meeting_id", "turn", F.flatten("words").alias("_said")), places, ["meeting_id", "turn"])
    each = spoken.select("meeting_id", "segment", F.explode("_said").alias("term"))
    return each.groupBy("meeting_id", "segment", "term").agg(F.count(F.lit(1)).alias("n"))


def segments(
    turns: DataFrame,
    shifts: DataFrame,
    terms_each: int = 3,
    block_turns: int = ordering.TURNS_PER_BLOCK,
    words: DataFrame | None = None,
) -> DataFrame:
    """First and last turn, counts and key terms of each stretch between shifts. Terms
    are weighed against all other stretches; there are never more than `terms_each`. `words`,
    from `terms.turn_words`, spares the text a reading."""
    # A few rows per meeting, read several times below.
    shifts = settle(shifts.select("meeting_id", "turn"))
    numbered = number_segments(turns.select("meeting_id", "turn", "speaker"), shifts, block_turns)
    return described(numbered, segment_terms(numbered, terms.turn_words(turns) if words is None else words), terms_each)


def described(numbered: DataFrame, spoken: DataFrame, terms_each: int = 3) -> DataFrame:
    """`segments` of turns that `number_segments` numbered, with what `segment_terms` counted in them."""
    key = ["meeting_id", "segment"]
    spans = numbered.groupBy(*key).agg(
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        F.count(F.lit(1)).alias("turns"),
        F.countDistinct("speaker").alias("speakers"),
    )
    weights = terms.term_weights(numbered, keys=("meeting_id", "segment"), words=spoken)
    best = terms.key_terms(numbered, terms_each, keys=("meeting_id", "segment"), weights=weights)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))
    names = best.groupBy(*key).agg(F.array_join(F.transform(ranked, lambda row: row["term"]), ", ").alias("terms"))
    return ordering.join_on(spans, names, key, "left")


def topic_threads(key_terms: DataFrame, limit: int = ordering.ROWS_IN_ONE_WINDOW) -> DataFrame:
    """For each key term of a meeting, the latest earlier meeting that had it too.

    A term shared by very many meetings makes a long chain but never a set of pairs.
    """
    rows = settle(key_terms.select("term", "meeting_id"))
    placed = ordering.block_by_range(rows, ["term"], ["meeting_id"], limit)
    linked = ordering.with_previous(placed, ["term"], ["meeting_id"], {"earlier_meeting": "meeting_id"})
    return linked.select("meeting_id", "term", "earlier_meeting")
