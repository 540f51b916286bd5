"""Live turns from a folder of files that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from minutary.sources.transcripts import CSV, as_turns, csv_schema, source_schema


def stream_turns(
    spark: SparkSession,
    path: str,
    delay: str = "10 minutes",
    fmt: str = "parquet",
    mapping: dict[str, str] | None = None,
    files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Turns as they arrive, with a watermark of `delay` on `started_at`.

    `files_per_trigger` bounds the work of a micro-batch.
    """
    mapping = mapping or {name: name for name in ("meeting_id", "turn", "speaker", "text", "started_at", "ended_at")}
    if fmt == "csv":
        # By the header of the files that are there; one with another header fails.
        reader = spark.readStream.schema(csv_schema(spark, path, mapping, options)).options(**CSV, **options)
    else:
        reader = spark.readStream.schema(source_schema(fmt, mapping)).options(**options)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return as_turns(reader.format(fmt).load(path), mapping).withWatermark("started_at", delay)


def drain_to_table(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Process what is there, write it as a table and stop. A restart goes on from the
    checkpoint, so both paths belong in shared storage."""
    query = (
        stream.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query
