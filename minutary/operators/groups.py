"""Groups of linked rows: who reaches whom, by tables of links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minutary.session import remove, settle, work_dir


def _flat(parents: DataFrame) -> DataFrame:
    """Everybody's parent's parent, once."""
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
    return parents.join(above, "parent").select("node", F.col("_above").alias("parent"))


def groups(links: DataFrame) -> DataFrame:
    """(node, group_id) for every node of `links` (a, b); the group is its smallest node.

    Each node has a parent, at first itself. In a round every link offers the smaller parent of its ends to the
    larger one, each takes the smallest offer, and parents' parents become parents. Only minima are
    gathered, and links whose ends have one parent go. Links with a null are none; a node linked to itself is a group.
    """
    spark = links.sparkSession
    known = links.filter("a IS NOT NULL AND b IS NOT NULL")
    ends = known.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    paths = [work_dir(spark, "groups"), work_dir(spark, "links")]
    parents = settle(ends.select("node", F.col("node").alias("parent")), paths[0])
    open_links = settle(known.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), paths[1])
    while not open_links.isEmpty():
        offers = open_links.groupBy(F.col("b").alias("parent")).agg(F.min("a").alias("_offer"))
        taken = parents.join(offers, "parent", "left").select("node", F.least("parent", "_offer").alias("parent"))
        before, paths = paths, [work_dir(spark, "groups"), work_dir(spark, "links")]
        parents = settle(_flat(_flat(taken)), paths[0])
        up = lambda side: parents.select(F.col("node").alias(side), F.col("parent").alias(f"_{side}"))
        moved = open_links.join(up("a"), "a").join(up("b"), "b").filter("_a <> _b")
        open_links = settle(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), paths[1])
        for path in before:
            remove(spark, path)
    # Parents of parents until none is left: a chain halves every time.
    while not parents.join(parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above")), "parent").filter("parent <> _above").isEmpty():
        before, paths[0] = paths[0], work_dir(spark, "groups")
        parents = settle(_flat(parents), paths[0])
        remove(spark, before)
    return parents.select("node", F.col("parent").alias("group_id"))
