"""Writing minutes so that a rerun gives the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_bucket(df: DataFrame, keys: list[str], buckets: int = 64) -> DataFrame:
    """A partition column with a fixed number of values, never one folder per meeting."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_minutes(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """Replace exactly the partitions of `by` that `df` holds.

    The rebalance hint gathers each partition's rows into few files, and splits a
    partition that is too large for one task.
    """
    (
        df.hint("rebalance", *[F.col(name) for name in by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .format(fmt)
        .save(path)
    )
