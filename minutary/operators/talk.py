"""Who talked, how much, and after whom.

Shares come from a join with per-meeting totals rather than a window over the meeting:
totals combine before the shuffle, and a join on a hot meeting can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from minutary.functions import text as tx
from minutary.operators import ordering, shaping

# The column of `handoffs` for all speakers that have none of their own.
OTHERS = "others"


def _by_speaker(turns: DataFrame) -> DataFrame:
    """Lengths come from a column `chars` where there is one."""
    chars = F.col("chars") if "chars" in turns.columns else F.length("text")
    return turns.groupBy("meeting_id", "speaker").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(chars).alias("chars"), F.min("turn").alias("first_turn")
    )


def speaker_stats(turns: DataFrame, reducer=None) -> DataFrame:
    """Turns, characters and share of the meeting's characters, by speaker.

    `reducer` adds a measure of the user's own over a speaker's texts: see
    `functions.hooks.speaker_measure`.
    """
    people = _by_speaker(turns)
    # All columns of `people` are used on both sides, so its shuffle is done once.
    totals = people.groupBy("meeting_id").agg(
        F.sum("turns").alias("_turns"), F.sum("chars").alias("_chars"), F.min("first_turn").alias("_first")
    )
    share = F.when(F.col("_chars") > 0, tx.rounded(F.col("chars") / F.col("_chars"))).otherwise(F.lit(0.0))
    turn_share = tx.rounded(F.col("turns") / F.col("_turns"))
    stats = ordering.join_on(people, totals, ["meeting_id"]).select(
        "meeting_id", "speaker", "turns", "chars", "first_turn", share.alias("share"), turn_share.alias("turn_share")
    )
    if reducer is not None:
        stats = ordering.join_on(stats, reducer(turns), ["meeting_id", "speaker"], "left")
    return stats


def meeting_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.countDistinct("speaker").alias("speakers"),
        F.min_by("speaker", "turn").alias("first_speaker"),
        F.max_by("speaker", "turn").alias("last_speaker"),
    )


def talk_totals(turns: DataFrame, mode: str = "rollup") -> DataFrame:
    """Turn counts with subtotals. `mode`: `rollup`, `cube` or `sets` (each speaker,
    each meeting, and everything). The flags tell a subtotal from a null value.

    Counting comes first, so only counts are multiplied by the subtotals.
    """
    counts = turns.groupBy("meeting_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    columns = [F.col("meeting_id"), F.col("speaker")]
    if mode == "rollup":
        grouped = counts.rollup(*columns)
    elif mode == "cube":
        grouped = counts.cube(*columns)
    elif mode == "sets":
        grouped = counts.groupingSets([[columns[0]], [columns[1]], []], *columns)
    else:
        raise ValueError(f"no such mode: {mode}")
    return grouped.agg(
        F.sum("n").alias("turns"),
        F.grouping("meeting_id").cast("int").alias("all_meetings"),
        F.grouping("speaker").cast("int").alias("all_speakers"),
    )


def handoffs(
    turns: DataFrame, wide: list[str] | None = None, block_turns: int = ordering.TURNS_PER_BLOCK
) -> DataFrame:
    """How often one speaker follows another, by meeting.

    `wide` names the speakers that become columns; `others` counts those to speakers not
    named, or without a name; a pair that never occurs is null.
    """
    narrow = ordering.block_by_turn(turns.select("meeting_id", "turn", "speaker"), block_turns)
    pairs = ordering.with_previous(narrow, ["meeting_id"], ["turn"], {"_before": "speaker", "_turn_before": "turn"})
    followed = pairs.filter(F.col("_turn_before").isNotNull()).select(
        "meeting_id", F.col("_before").alias("from_speaker"), F.col("speaker").alias("to_speaker")
    )
    if wide is None:
        return followed.groupBy("meeting_id", "from_speaker", "to_speaker").agg(F.count(F.lit(1)).alias("times"))
    column = F.when(F.col("to_speaker").isin(wide), F.col("to_speaker")).otherwise(F.lit(OTHERS))
    named = followed.withColumn("to_speaker", column)
    return named.groupBy("meeting_id", "from_speaker").pivot("to_speaker", [*wide, OTHERS]).agg(F.count(F.lit(1)))


def length_ranks(turns: DataFrame) -> DataFrame:
    """Rank of each length in its meeting, longest first.

    Ranking works on distinct lengths, of which there are never more than characters in
    the longest turn, however many turns there are.
    """
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    lengths = turns.groupBy("meeting_id", chars.alias("chars")).agg(F.count(F.lit(1)).alias("n"))
    longest_first = Window.partitionBy("meeting_id").orderBy(F.desc("chars"))
    meeting = Window.partitionBy("meeting_id")
    total = F.sum("n").over(meeting)
    longer = F.sum("n").over(longest_first) - F.col("n")
    return lengths.select(
        "meeting_id",
        "chars",
        (longer + 1).alias("rank"),
        F.row_number().over(longest_first).cast("long").alias("dense_rank"),
        (F.floor(longer * 4 / total) + 1).alias("quartile"),
        F.sum(F.col("n") * F.col("chars")).over(meeting).alias("meeting_chars"),
    )


def turn_flow(turns: DataFrame, block_turns: int = ordering.TURNS_PER_BLOCK) -> DataFrame:
    """Per turn: the next speaker and length, the running share of talk, and rank,
    dense rank and quartile by length. Turns of equal length share a quartile."""
    key, order = ["meeting_id"], ["turn"]
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    short = turns.select("meeting_id", "turn", "speaker", chars.alias("chars"))
    rows = ordering.with_next(
        ordering.block_by_turn(short, block_turns), key, order, {"next_speaker": "speaker", "next_chars": "chars"}
    )
    rows = ordering.carry(rows, key, {"_before": (F.sum("chars"), "sum")})
    running = F.sum("chars").over(ordering.so_far(key, order)) + F.coalesce("_before", F.lit(0))
    rows = rows.withColumn("running_chars", running).drop("_before", ordering.BLOCK)
    total = F.col("meeting_chars")
    share = F.when(total > 0, tx.rounded(F.col("running_chars") / total)).otherwise(F.lit(0.0))
    ranked = ordering.join_on(rows, length_ranks(turns), ["meeting_id", "chars"])
    return ranked.withColumn("running_share", share).drop("meeting_chars")


def balance(turns: DataFrame) -> DataFrame:
    """Evenness of talk: entropy of turn shares in nats, 0 with one speaker.

    -sum(p ln p) with p = n / N is ln N - sum(n ln n) / N, which needs no second pass.
    """
    people = turns.groupBy("meeting_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    entropy = F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n)
    return people.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("speakers"), tx.rounded(entropy).alias("evenness")
    )


def length_profile(turns: DataFrame) -> DataFrame:
    """Exact median and 90th percentile of turn length by meeting."""
    quantiles = F.percentile(F.length("text"), F.array(F.lit(0.5), F.lit(0.9)))
    return turns.groupBy("meeting_id").agg(quantiles.alias("q")).select(
        "meeting_id", tx.rounded(F.col("q")[0]).alias("median_chars"), tx.rounded(F.col("q")[1]).alias("p90_chars")
    )


def vocabulary(turns: DataFrame) -> DataFrame:
    """Estimated number of different words by meeting, with the sketch it came from, so
    that estimates of many meetings can be merged without reading the text again."""
    sketched = shaping.tokens(turns).groupBy("meeting_id").agg(F.hll_sketch_agg("word").alias("sketch"))
    return sketched.select("meeting_id", F.hll_sketch_estimate("sketch").alias("words"), "sketch")


def merged_vocabulary(sketches: DataFrame, by: Column | None = None) -> DataFrame:
    """Estimated number of different words over several meetings."""
    grouped = sketches.groupBy() if by is None else sketches.groupBy(by)
    return grouped.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("words"))


def length_sketches(turns: DataFrame) -> DataFrame:
    """(meeting_id, sketch): a quantile sketch (KLL, of Spark's default size) of the lengths of a meeting's turns, null if none has a
    text. Sketches are kept and merged in place of the text."""
    return turns.groupBy("meeting_id").agg(F.kll_sketch_agg_bigint(F.length("text").cast("long")).alias("sketch"))


def merged_lengths(sketches: DataFrame, quantiles: list[float], by: Column | None = None) -> DataFrame:
    """(turns, q0, q1, ...): lengths below which these shares of the turns of several meetings lie. A length given for a
    share has that rank to within 0.02 or so of all turns, whatever the number of sketches."""
    grouped = sketches.groupBy() if by is None else sketches.groupBy(by)
    merged = grouped.agg(F.kll_merge_agg_bigint("sketch").alias("_all"))
    keys = [name for name in merged.columns if name != "_all"]
    asked = [F.kll_sketch_get_quantile_bigint("_all", F.lit(share)).alias(f"q{at}") for at, share in enumerate(quantiles)]
    return merged.select(*keys, F.kll_sketch_get_n_bigint("_all").alias("turns"), *asked)


def longest_turns(turns: DataFrame, k: int) -> DataFrame:
    """The k longest turns overall, ties by key. Each task keeps k rows."""
    short = turns.select("meeting_id", "turn", "speaker", F.length("text").alias("chars"))
    return short.orderBy(F.desc("chars"), "meeting_id", "turn").limit(k)
