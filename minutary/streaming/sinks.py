"""Sinks that give the same table when a batch is written twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from minutary.session import remove, settle, work_dir
from minutary.sources.sinks import with_bucket, write_minutes


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def split_late(path: str, delay_seconds: int, at: str = "started_at") -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: rows later than the delay go to `path`/late, the others
    to `path`/ontime, and none is lost.

    Lateness is against the highest time of all earlier batches, kept in `path`/marks for
    the last two. Everything is written under the batch's own partition, so a batch that
    runs again after a failure reads the same mark and replaces its own rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = _read_or_none(spark, f"{path}/marks")
        high = None
        if marks is not None:
            high = marks.filter(F.col("batch_id") < batch_id).agg(F.max("high_micros")).first()[0]
        rows = batch.withColumn("batch_id", F.lit(batch_id))
        if high is None:
            late = F.lit(False)
        else:
            late = F.coalesce(F.unix_micros(at) < high - delay_seconds * 1_000_000, F.lit(False))
        rows = rows.withColumn("_late", late).persist()
        try:
            write_minutes(rows.filter("_late").drop("_late"), f"{path}/late", ["batch_id"])
            write_minutes(rows.filter("NOT _late").drop("_late"), f"{path}/ontime", ["batch_id"])
            top = F.greatest(F.max(F.unix_micros(at)), F.lit(high).cast("long")).alias("high_micros")
            write_minutes(rows.agg(top).withColumn("batch_id", F.lit(batch_id)), f"{path}/marks", ["batch_id"])
            remove(spark, f"{path}/marks/batch_id={batch_id - 2}")
        finally:
            rows.unpersist()

    return handle


def newest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; copies of a key combine before the shuffle."""
    rest = [name for name in rows.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(newest.alias("_newest")).select(*keys, "_newest.*").select(*rows.columns)


def upsert_sink(path: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that keeps the newest row per key in a table.

    `order` says what is newest and has to be unique for a key. Only the buckets that
    the batch touches are read and replaced; a batch written twice changes nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        drafts = [work_dir(spark, "upsert"), work_dir(spark, "upsert")]
        try:
            merge(spark, batch, drafts)
        finally:
            for draft in drafts:
                remove(spark, draft)

    def merge(spark: SparkSession, batch: DataFrame, drafts: list[str]) -> None:
        # Reduced and written out first: it is needed for the bucket list and the merge.
        fresh = settle(with_bucket(newest_rows(batch, keys, order), keys, buckets), drafts[0])
        touched = [row["bucket"] for row in fresh.select("bucket").distinct().collect()]
        if not touched:
            return
        merged = fresh
        table = _read_or_none(spark, path)
        if table is not None:
            kept = table.filter(F.col("bucket").isin(touched)).select(*fresh.columns)
            merged = newest_rows(kept.unionByName(fresh), [*keys, "bucket"], order)
            # The partitions read here are the ones replaced below.
            merged = settle(merged, drafts[1])
        write_minutes(merged, path, ["bucket"])

    return handle
