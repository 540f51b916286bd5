"""Compare Spark queries with DuckDB on the same parquet files."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb


def tables(sf_dir: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted(tuple(plain(row[at]) for at in order) for row in rows)


def differences(spark_df, sql: str, connection) -> list[str]:
    """What is not the same, at most a few lines; nothing if all is."""
    found = connection.sql(sql)
    columns, theirs = list(found.columns), found.fetchall()
    if sorted(spark_df.columns) != sorted(columns):
        return [f"columns {sorted(spark_df.columns)} and {sorted(columns)}"]
    ours = [tuple(row) for row in spark_df.collect()]
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows and {len(theirs)}"]
    pairs = zip(rows_of(spark_df.columns, ours), rows_of(columns, theirs))
    return [f"{left}\n    {right}" for left, right in pairs if left != right][:3]
