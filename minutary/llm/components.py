"""Connected components of a link table, by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from minutary.session import remove, settle, work_dir


def _mark(edges: DataFrame):
    """Count and order-free checksum of a table of edges."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def _largest_to_smallest(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """u and its neighbours, all below u, are tied to the smallest of them."""
    lows = edges.groupBy("u").agg(F.min("v").alias("low"))
    others = edges.join(lows, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return others.unionByName(lows.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in `links` (a, b); component is the smallest node.

    Each round is aggregates, which combine before the shuffle, and plain joins, whose hot
    keys adaptive execution splits; no node's neighbours are gathered. A round is written to
    the shared folder. Rounds go on until nothing changes. Nulls and loops are no links.
    """
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    spark = links.sparkSession
    path = work_dir(spark, "edges")
    edges = settle(ends.distinct(), path)
    mark = _mark(edges)
    while True:
        before, path = path, work_dir(spark, "edges")
        edges = settle(_smaller_to_smallest(_largest_to_smallest(edges)), path)
        found = _mark(edges)
        remove(spark, before)
        if found == mark:
            break
        mark = found
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
