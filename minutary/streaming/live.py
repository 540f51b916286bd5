"""Live views of a meeting. Each takes a stream or a plain table of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minutary.operators import joins, ordering
from minutary.streaming import state


def live_counts(turns: DataFrame, width: str) -> DataFrame:
    """Turns by speaker in windows of `width`."""
    window = F.window("started_at", width)
    return _spanned(turns.groupBy(window.alias("span"), "speaker").agg(F.count(F.lit(1)).alias("turns")))


def live_sliding(turns: DataFrame, width: str, step: str) -> DataFrame:
    """Turns by speaker in windows of `width`, one starting every `step`."""
    window = F.window("started_at", width, step)
    return _spanned(turns.groupBy(window.alias("span"), "speaker").agg(F.count(F.lit(1)).alias("turns")))


def _spanned(counts: DataFrame) -> DataFrame:
    rest = [name for name in counts.columns if name != "span"]
    return counts.select(F.col("span.start").alias("begins_at"), F.col("span.end").alias("ends_at"), *rest)


def with_session(turns: DataFrame, gap_seconds: int, limit: int = ordering.ROWS_IN_ONE_WINDOW) -> DataFrame:
    """Add `begins_at`, the start of the session each turn belongs to (tables only).

    A silence of `gap_seconds` or more ends a session. Turn ids have to be unique. A
    large meeting is written out on the way, so pass only the columns needed.
    """
    key, order = ["meeting_id"], ["started_at", "turn"]
    placed = ordering.block_by_range(turns.filter(F.col("started_at").isNotNull()), key, order, limit)
    rows = placed.withColumn("_at", F.col("started_at"))
    near = ordering.with_previous(rows, key, order, {"_before": "_at"})
    silence = F.unix_micros("started_at") - F.unix_micros("_before")
    opens = F.col("_before").isNull() | (silence >= gap_seconds * 1_000_000)
    marked = near.withColumn("_opens", F.when(opens, F.col("started_at")))
    carried = ordering.carry(marked, key, {"_open_before": (F.max("_opens"), "max")})
    begins = F.coalesce(F.max("_opens").over(ordering.so_far(key, order)), F.col("_open_before"))
    return carried.select(*turns.columns, begins.alias("begins_at"))


def live_sessions(turns: DataFrame, gap_seconds: int, limit: int = ordering.ROWS_IN_ONE_WINDOW) -> DataFrame:
    """Meetings found by silence: a gap of `gap_seconds` or more closes one.

    On a stream this is Spark's session window. On a table it goes by ordered blocks,
    so one endless meeting is not sorted by a single task.
    """
    if turns.isStreaming:
        # Spark's session takes in a row at exactly its end, so it is a microsecond short.
        window = F.session_window("started_at", f"{gap_seconds * 1_000_000 - 1} microseconds")
        spans = turns.groupBy("meeting_id", window.alias("span")).agg(F.count(F.lit(1)).alias("turns"))
        ends = F.col("ends_at") + F.expr("INTERVAL '0.000001' SECOND")
        return _spanned(spans).select("meeting_id", "begins_at", ends.alias("ends_at"), "turns")
    short = turns.select("meeting_id", "turn", "started_at")
    found = with_session(short, gap_seconds, limit).groupBy("meeting_id", "begins_at")
    last = F.max("started_at") + F.expr(f"INTERVAL {gap_seconds} SECONDS")
    return found.agg(last.alias("ends_at"), F.count(F.lit(1)).alias("turns"))


def drop_replays(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows seen before within the delay. State holds keys for that long only."""
    if stream.isStreaming:
        return stream.dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def live_roster(stream: DataFrame, roster: DataFrame) -> DataFrame:
    """Names added to a live stream from a table; Spark sizes up the table by itself."""
    return joins.roster_join(stream, roster, "left")


def live_pairs(
    turns: DataFrame,
    opener: str,
    reply: str,
    within_seconds: int,
    limit: int = ordering.ROWS_IN_ONE_WINDOW,
) -> DataFrame:
    """Match each turn by `reply` to the latest one by `opener` at or before it in the
    meeting, no further back than `within_seconds`; without a match there is no row.

    One opener per reply is kept in state (or carried down the order), where a join of
    the two streams would pair every reply with every opener in reach.
    """
    if opener == reply:
        raise ValueError("opener and reply have to differ")
    if turns.isStreaming:
        return state.paired(turns, opener, reply, within_seconds)
    replies = turns.filter(F.col("speaker") == reply).select("meeting_id", "turn", "started_at")
    openers = turns.filter(F.col("speaker") == opener).select(
        "meeting_id", F.col("turn").alias("opener_turn"), F.col("started_at").alias("opened_at")
    )
    found = joins.latest_before(
        replies, openers, at="started_at", row_id="turn", mark_at="opened_at", mark_id="opener_turn",
        values=["opener_turn", "opened_at"], limit=limit,
    )
    waited = F.unix_micros("started_at") - F.unix_micros("opened_at")
    return found.filter(waited <= within_seconds * 1_000_000).select(
        "meeting_id", "turn", "opener_turn", waited.alias("waited_micros")
    )


def session_minutes(turns: DataFrame, gap_seconds: int, limit: int = ordering.ROWS_IN_ONE_WINDOW) -> DataFrame:
    """Per session and speaker: turns, characters, end of session and its last speaker.
    The same figures as `state.running_minutes`, from a table."""
    short = turns.select("meeting_id", "turn", "speaker", "started_at", F.length("text").alias("chars"))
    spoken = with_session(short, gap_seconds, limit)
    key = ["meeting_id", "begins_at"]
    people = spoken.groupBy(*key, "speaker").agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("chars").alias("chars"),
        F.max(F.struct("started_at", "turn")).alias("_last"),
    )
    ends = people.groupBy(*key).agg(
        F.max(F.struct(F.col("_last.started_at"), F.col("_last.turn"), F.col("speaker"))).alias("_end")
    )
    return ordering.join_on(people, ends, key).select(
        *key, F.col("_end.started_at").alias("last_at"), "speaker", "turns", "chars", F.col("_end.speaker").alias("last_speaker")
    )
