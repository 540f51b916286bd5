"""Ordered work inside a meeting without one task per meeting.

A window over a whole meeting would put every row of the largest meeting into one
task. Here rows carry a block number that grows with their order. Windows run inside
(keys, block), and one small row per block carries over what the earlier blocks add up
to (or, for look-ahead, what comes next).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from minutary.session import settle

BLOCK = "_block"
TURNS_PER_BLOCK = 1 << 16
ROWS_IN_ONE_WINDOW = 1 << 20


def block_by_turn(rows: DataFrame, size: int = TURNS_PER_BLOCK) -> DataFrame:
    """Blocks of `size` turn numbers. Turns are unique, so a block is bounded."""
    return rows.withColumn(BLOCK, F.floor(F.col("turn") / size))


def block_by_range(
    rows: DataFrame, keys: list[str], order: list[str], limit: int = ROWS_IN_ONE_WINDOW
) -> DataFrame:
    """Blocks for any order, such as time, where equal values may pile up.

    `order` must be unique inside `keys`. One count finds the largest group; if it fits
    in one window, the whole group is one block. Otherwise rows are range-partitioned by
    keys and order into blocks of about `limit` rows, which splits a hot key or a hot
    instant, and the partition number is the block. It is written out, because a second
    run may sample other bounds.
    """
    sizes = rows.groupBy(*keys).count()
    found = sizes.agg(F.max("count").alias("largest"), F.sum("count").alias("all")).first()
    if (found["largest"] or 0) <= limit:
        return rows.withColumn(BLOCK, F.lit(0))
    partitions = math.ceil(found["all"] / limit)
    placed = rows.repartitionByRange(partitions, *keys, *order).withColumn(BLOCK, F.spark_partition_id())
    return settle(placed)


def carry(
    rows: DataFrame,
    keys: list[str],
    parts: dict[str, tuple[Column, str]],
    ahead: bool = False,
) -> DataFrame:
    """Join to each row what all earlier (or, `ahead`, later) blocks come to.

    `parts` maps a new column to (aggregate over one block, fold over blocks), where
    the fold is "sum", "max", "last" or "first".
    """
    folds = {
        "sum": F.sum,
        "max": F.max,
        "last": lambda name: F.last(name, ignorenulls=True),
        "first": lambda name: F.first(name, ignorenulls=True),
    }
    blocks = rows.groupBy(*keys, BLOCK).agg(*[agg.alias(name) for name, (agg, _) in parts.items()])
    frame = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
    others = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(*frame)
    carried = blocks.select(
        *keys, BLOCK, *[folds[fold](name).over(others).alias(name) for name, (_, fold) in parts.items()]
    )
    return join_on(rows, carried, [*keys, BLOCK], "left")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys meet null keys, as they do in a window or a group."""
    named = right.select(
        *[F.col(name).alias(f"_key{at}") for at, name in enumerate(keys)], *[name for name in right.columns if name not in keys]
    )
    same = F.lit(True)
    for at, name in enumerate(keys):
        same = same & F.col(name).eqNullSafe(F.col(f"_key{at}"))
    return left.join(named, same, how).drop(*[f"_key{at}" for at in range(len(keys))])


def earlier_blocks(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def in_block(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def so_far(keys: list[str], order: list[str]):
    """The rows of the block up to and with the current one."""
    return in_block(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def with_previous(
    rows: DataFrame, keys: list[str], order: list[str], values: dict[str, str]
) -> DataFrame:
    """Add columns of the row before, null at the start. `values`: new name -> column."""
    packed = F.struct(*[F.col(old).alias(new) for new, old in values.items()])
    edge = F.max_by(packed, F.struct(*order))
    window = in_block(keys, order)
    near = F.when(F.row_number().over(window) == 1, F.col("_edge")).otherwise(F.lag(packed).over(window))
    carried = carry(rows, keys, {"_edge": (edge, "last")})
    found = carried.withColumn("_near", near)
    return found.select(*rows.columns, *[F.col(f"_near.{new}").alias(new) for new in values])


def with_next(
    rows: DataFrame, keys: list[str], order: list[str], values: dict[str, str]
) -> DataFrame:
    """Add columns of the row after, null at the end."""
    packed = F.struct(*[F.col(old).alias(new) for new, old in values.items()])
    edge = F.min_by(packed, F.struct(*order))
    near = F.coalesce(F.lead(packed).over(in_block(keys, order)), F.col("_edge"))
    carried = carry(rows, keys, {"_edge": (edge, "first")}, ahead=True)
    found = carried.withColumn("_near", near)
    return found.select(*rows.columns, *[F.col(f"_near.{new}").alias(new) for new in values])
