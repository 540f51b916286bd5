"""Sorting out rows that cannot go into minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minutary.operators import ordering


def label_turns(turns: DataFrame) -> DataFrame:
    """Add `reason`: null for a good row, else the first that holds of missing key,
    duplicate key, blank text and null speaker. All rows of a repeated key are rejected, since none
    can be told to be the right one.

    Repeats are found by a count that combines before the shuffle, so a key repeated
    over a third of the table is one row per task there.
    """
    keys = ["meeting_id", "turn"]
    repeated = turns.groupBy(*keys).count().filter("count > 1").select(*keys, F.lit(True).alias("_twice"))
    reason = (
        F.when(F.col("meeting_id").isNull() | F.col("turn").isNull(), "missing key")
        .when(F.col("_twice"), "duplicate key")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "blank text")
        .when(F.col("speaker").isNull(), "null speaker")
    )
    return turns.join(repeated, keys, "left").select(*turns.columns, reason.alias("reason"))


def check_turns(
    turns: DataFrame, block_turns: int = ordering.TURNS_PER_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects). Clean rows say in `missing_before` how many turn numbers are
    skipped before them; rejects carry one `reason`."""
    labelled = label_turns(turns)
    good = labelled.filter(F.col("reason").isNull()).drop("reason")
    placed = ordering.with_previous(
        ordering.block_by_turn(good, block_turns), ["meeting_id"], ["turn"], {"_before": "turn"}
    )
    missing = F.coalesce(F.col("turn") - F.col("_before") - 1, F.lit(0))
    clean = placed.select(*turns.columns, missing.alias("missing_before"))
    return clean, labelled.filter(F.col("reason").isNotNull())
