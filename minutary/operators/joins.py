"""Joining turns to invited people, to the agenda and to overlapping turns.

No side is broadcast by hand: rosters and agendas grow with the meetings, so Spark
decides by their size, and adaptive execution splits a hot meeting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minutary.operators import ordering

_PERSON = ["meeting_id", "speaker"]


def roster_join(turns: DataFrame, roster: DataFrame, how: str = "left") -> DataFrame:
    """`left` adds name and role, `semi` keeps turns of invited people, `anti` the rest."""
    invited = roster.select(*_PERSON, "name", "role")
    if how == "left":
        return turns.join(invited, _PERSON, "left")
    return turns.join(invited.select(*_PERSON), _PERSON, f"left_{how}")


def absentees(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """Invited people who never spoke. Turns are reduced to speakers first, so a
    meeting with very many turns is a handful of rows in the join."""
    spoke = turns.select(*_PERSON).distinct()
    return roster.join(spoke, _PERSON, "left_anti")


def latest_before(
    rows: DataFrame,
    marks: DataFrame,
    at: str,
    row_id: str,
    mark_at: str,
    mark_id: str,
    values: list[str],
    keys: list[str] | None = None,
    limit: int = ordering.ROWS_IN_ONE_WINDOW,
) -> DataFrame:
    """For each row, `values` of the latest mark with `mark_at <= at` under the same
    keys; null before the first. On equal times the mark with the highest id wins.

    Rows and marks are put in one order and the last mark is carried down, so no pair
    of row and mark is ever formed. Both have to be unique by time and id.
    """
    keys = keys or ["meeting_id"]
    of_rows = rows.select(
        *keys,
        F.col(at).alias("_at"),
        F.lit(1).alias("_side"),
        F.col(row_id).alias("_id"),
        F.struct(*[name for name in rows.columns if name not in keys]).alias("_row"),
    )
    of_marks = marks.filter(F.col(mark_at).isNotNull()).select(
        *keys,
        F.col(mark_at).alias("_at"),
        F.lit(0).alias("_side"),
        F.col(mark_id).alias("_id"),
        F.struct(*values).alias("_mark"),
    )
    both = of_rows.unionByName(of_marks, allowMissingColumns=True)
    order = ["_at", "_side", "_id"]
    placed = ordering.block_by_range(both, keys, order, limit)
    newest = F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.struct(*order)))
    carried = ordering.carry(placed, keys, {"_mark_before": (newest, "last")})
    here = F.last("_mark", ignorenulls=True).over(ordering.so_far(keys, order))
    found = carried.withColumn("_found", F.coalesce(here, F.col("_mark_before"))).filter("_side = 1")
    return found.select(*keys, "_row.*", *[F.col(f"_found.{name}").alias(name) for name in values])


def agenda_asof(
    turns: DataFrame, agenda: DataFrame, limit: int = ordering.ROWS_IN_ONE_WINDOW
) -> DataFrame:
    """The agenda item under discussion at each turn: the latest one that has started."""
    return latest_before(
        turns, agenda, at="started_at", row_id="turn", mark_at="starts_at", mark_id="item",
        values=["item", "title"], limit=limit,
    )


def interruptions(turns: DataFrame, limit: int = ordering.ROWS_IN_ONE_WINDOW) -> DataFrame:
    """Per turn, how often another speaker starts strictly inside its time span.

    Listing the overlapping pairs can grow with the square of a busy meeting. The count
    cannot: starts before the end less starts up to the start, once for everybody and
    once for the turn's own speaker. Each turn becomes three points in time order (its
    end, its start, and a reading taken after all starts at that instant). A turn without a
    speaker interrupts nobody and has a count of 0.
    """
    timed = turns.filter("started_at IS NOT NULL AND ended_at IS NOT NULL")
    points = F.array(
        F.struct(F.col("ended_at").alias("_at"), F.lit(0).alias("_kind")),
        F.struct(F.col("started_at").alias("_at"), F.lit(1).alias("_kind")),
        F.struct(F.col("started_at").alias("_at"), F.lit(2).alias("_kind")),
    )
    line = timed.select("meeting_id", "speaker", "turn", F.inline(points))
    everybody, own = ["meeting_id"], _PERSON
    order = ["_at", "_kind", "turn"]
    placed = ordering.block_by_range(line, everybody, order, limit)
    start = F.sum(((F.col("_kind") == 1) & F.col("speaker").isNotNull()).cast("long"))
    counted = ordering.carry(placed, everybody, {"_all_before": (start, "sum")})
    counted = ordering.carry(counted, own, {"_own_before": (start, "sum")})
    by_all = start.over(ordering.so_far(everybody, order)) + F.coalesce("_all_before", F.lit(0))
    by_own = start.over(ordering.so_far(own, order)) + F.coalesce("_own_before", F.lit(0))
    others = counted.withColumn("_others", by_all - by_own)
    sign = F.when(F.col("speaker").isNull(), 0).when(F.col("_kind") == 0, 1).when(F.col("_kind") == 2, -1).otherwise(0)
    # A turn that ends at its start (or before) has no inside.
    return others.groupBy("meeting_id", "turn", "speaker").agg(
        F.greatest(F.sum(sign * F.col("_others")), F.lit(0)).alias("interruptions")
    )
