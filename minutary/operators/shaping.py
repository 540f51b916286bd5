"""Filtering turns, joining neighbours of one speaker, and splitting text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from minutary.functions import text as tx
from minutary.operators import ordering

TURNS_PER_PIECE = 1000


def select_turns(
    turns: DataFrame,
    speakers: list[str] | None = None,
    pattern: str | None = None,
    min_chars: int | None = None,
) -> DataFrame:
    """Turns that satisfy every test given. The speaker test reaches the scan."""
    if speakers is not None:
        turns = turns.filter(F.col("speaker").isin(speakers))
    if pattern is not None:
        turns = turns.filter(F.col("text").rlike(pattern))
    if min_chars is not None:
        turns = turns.filter(F.length("text") >= min_chars)
    return turns


def stretches(turns: DataFrame, block_turns: int = ordering.TURNS_PER_BLOCK) -> DataFrame:
    """Add `first_turn`, the turn that opens the run of one speaker, and `place`, the
    position in that run from 0. No row is dropped: turns without a meeting are one meeting,
    and a turn without a number comes first in it."""
    key, order = ["meeting_id"], ["turn"]
    placed = ordering.with_previous(
        ordering.block_by_turn(turns, block_turns), key, order, {"_speaker_before": "speaker", "_turn_before": "turn"}
    )
    opens = F.col("_turn_before").isNull() | ~F.col("speaker").eqNullSafe(F.col("_speaker_before"))
    rows = placed.select(
        *turns.columns,
        ordering.BLOCK,
        F.row_number().over(ordering.in_block(key, order)).alias("_number"),
        F.when(opens, F.col("turn")).alias("_opens"),
    )
    # Rows are numbered in their block; a block's first number and the number of the
    # latest opening before it follow from one row per block.
    blocks = rows.groupBy(*key, ordering.BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max("_opens").alias("_last_open"),
        F.max(F.when(F.col("_opens").isNotNull(), F.col("_number"))).alias("_last_at"),
    )
    earlier = ordering.earlier_blocks(key)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    carried = blocks.select(
        *key,
        ordering.BLOCK,
        "_start",
        F.max("_last_open").over(earlier).alias("_open_before"),
        F.max(F.col("_start") + F.col("_last_at")).over(earlier).alias("_at_before"),
    )
    window = ordering.so_far(key, order)
    number = F.col("_start") + F.col("_number")
    opened = F.max(F.when(F.col("_opens").isNotNull(), number)).over(window)
    return ordering.join_on(rows, carried, [*key, ordering.BLOCK]).select(
        *turns.columns,
        F.coalesce(F.max("_opens").over(window), F.col("_open_before")).alias("first_turn"),
        (number - F.coalesce(opened, F.col("_at_before"))).alias("place"),
    )


def stitch_turns(
    turns: DataFrame,
    piece_turns: int = TURNS_PER_PIECE,
    block_turns: int = ordering.TURNS_PER_BLOCK,
) -> DataFrame:
    """Merge neighbouring turns of one speaker, text joined by newlines in order.

    A run longer than `piece_turns` comes as several pieces numbered from 0, so no text
    grows without bound and none is cut off.
    """
    piece = F.floor(F.col("place") / piece_turns).alias("piece")
    runs = stretches(turns, block_turns).groupBy("meeting_id", F.col("first_turn").alias("turn"), piece, "speaker")
    texts = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("at"), "text")))
    return runs.agg(
        F.count(F.lit(1)).alias("turns"),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.array_join(F.transform(texts, lambda row: row["text"]), "\n").alias("text"),
    )


def sentences(turns: DataFrame, keep: Iterable[str] = ("meeting_id", "turn"), splitter=None) -> DataFrame:
    """One row per sentence, numbered from 0 in its turn; blanks are dropped.

    `splitter` replaces the built-in rule: see `functions.hooks.sentence_splitter`.
    """
    keep = list(keep)
    if splitter is not None:
        spark = turns.sparkSession
        spark.udtf.register("minutary_splitter", splitter)
        columns = ", ".join(f"t.{name}" for name in keep)
        return spark.sql(
            f"SELECT {columns}, s.pos, s.sentence FROM {{turns}} t, LATERAL minutary_splitter(t.text) s",
            turns=turns,
        )
    return turns.select(*keep, F.posexplode(tx.sentence_list(F.col("text"))).alias("pos", "sentence"))


def tokens(turns: DataFrame, keep: Iterable[str] = ("meeting_id", "turn"), text: Column | str = "text") -> DataFrame:
    """One row per word, lower-cased."""
    source = F.col(text) if isinstance(text, str) else text
    return turns.select(*keep, F.explode(tx.word_list(source)).alias("word"))
