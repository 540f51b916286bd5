"""Arrow batches in tasks: pieces of bounded size, and rows that stand in sorted runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_IN_HAND = 256
BYTES_IN_HAND = 1 << 20


def pieces(
    batches: Iterator[pa.RecordBatch], rows: int = ROWS_IN_HAND, text: str | None = None, size: int = BYTES_IN_HAND
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows` and, if `text` names a column, about `size` bytes
    of it, so that few Python objects live at once. A longer text is a slice of its own."""
    for batch in batches:
        cuts = set(range(0, batch.num_rows, rows))
        if text:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())
            cuts |= {int(at) + 1 for at in passed(ends, size)}
        bounds = [*sorted(cut for cut in cuts if cut < batch.num_rows), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            yield batch.slice(start, end - start)


def passed(ends: np.ndarray, size: int) -> np.ndarray:
    """Rows after which a running total passes another multiple of `size`."""
    return np.flatnonzero(np.diff(ends // size, prepend=0))


def text_bytes(name: str = "text") -> Column:
    """A text as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def words_of(text: bytes) -> list[bytes]:
    """Words between runs of space, tab, LF, VT, FF and CR, with A-Z lower-cased.

    Python's `lower` and `split` on bytes know exactly these characters.
    """
    return text.lower().split()


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, for columns of the same length."""
    changed = np.zeros(len(columns[0]), dtype=bool)
    changed[:1] = True
    for column in columns:
        changed[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changed)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches as arrays, cut between runs of equal `keys`, so that no run is torn.

    Only for groups of bounded size: the last run of a batch waits for the next one.
    """
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if not table.num_rows:
            continue
        arrays = {name: table.column(name).to_numpy() for name in keys}
        cut = int(run_starts(*arrays.values())[-1])
        if cut:
            yield {name: table.column(name).slice(0, cut).to_numpy() for name in table.column_names}
        held = table.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield {name: held.column(name).to_numpy() for name in held.column_names}


def map_arrow(df: DataFrame, step: Callable, schema: str | StructType) -> DataFrame:
    """`mapInArrow` for a step that yields dicts of columns rather than record batches."""
    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def column(values, kind: pa.DataType) -> pa.Array:
        if isinstance(values, pa.Array):
            return values if values.type == kind else values.cast(kind)
        return pa.array(values, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in step(batches):
            yield pa.RecordBatch.from_arrays([column(columns[field.name], field.type) for field in target], schema=target)

    return df.mapInArrow(run, schema)


def with_fields(packed: DataFrame, kept: list[str], step: Callable, added: str) -> DataFrame:
    """`map_arrow` to the columns `kept`, as they are, and those of the DDL `added`."""
    fields = packed.select(*kept).schema.fields + StructType.fromDDL(added).fields
    return map_arrow(packed, step, StructType(fields))
