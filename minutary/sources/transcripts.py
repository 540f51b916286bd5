"""Reading transcripts into the TURNS schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from minutary import schemas

# Timestamps without a zone cannot be read as timestamps from parquet; they are
# declared as they are stored and cast, in UTC, on the way in.
TIMES = ("started_at", "ended_at")
CSV = {"header": "true", "escape": '"', "enforceSchema": "false"}

_STORED_TIME = {"parquet": T.TimestampNTZType(), "orc": T.TimestampType()}


def source_schema(fmt: str, mapping: dict[str, str]) -> T.StructType:
    """Schema of the source, from the columns it is mapped to."""
    fields = []
    for ours in schemas.TURNS:
        if ours.name in mapping:
            kind = ours.dataType
            if isinstance(kind, T.TimestampType):
                kind = _STORED_TIME.get(fmt, kind)
            fields.append(T.StructField(mapping[ours.name], kind))
    return T.StructType(fields)


def csv_schema(spark: SparkSession, path: str, mapping: dict[str, str], options: dict[str, str]) -> T.StructType:
    """The columns of CSV files as texts, in the order of their header. Names decide what is
    what; a mapped name that is not there, unless it is a time, or another file with another
    header, is an error."""
    header = spark.read.options(**CSV, **options).csv(path).columns
    missing = sorted(name for ours, name in mapping.items() if name not in header and ours not in TIMES)
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header")
    return T.StructType([T.StructField(name, T.StringType()) for name in header])


def as_turns(source: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename and cast to TURNS; a column without a source is null, as is a value that
    cannot be cast."""
    mapping = mapping or {field.name: field.name for field in schemas.TURNS}
    columns = []
    for field in schemas.TURNS:
        found = F.col(mapping[field.name]) if mapping.get(field.name) in source.columns else F.lit(None)
        columns.append(found.try_cast(field.dataType).alias(field.name))
    return source.select(*columns)


def read_turns(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    mapping: dict[str, str] | None = None,
    **options: str,
) -> DataFrame:
    """Load a transcript kept as parquet, ORC, JSON lines or CSV with a header."""
    mapping = mapping or {field.name: field.name for field in schemas.TURNS}
    if fmt == "csv":
        reader = spark.read.schema(csv_schema(spark, path, mapping, options)).options(**CSV)
    else:
        reader = spark.read.schema(source_schema(fmt, mapping))
    return as_turns(reader.options(**options).format(fmt).load(path), mapping)
