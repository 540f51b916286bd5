"""Places where a user's own Python takes part, always over batches of rows.

The wrappers are built inside functions, so Spark ships them to executors by value and
the package need not be installed there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def sentence_scorer(score: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """`scorer=` of key_sentences: a batch of sentences to a batch of scores."""

    @F.pandas_udf("double")
    def scored(batch: pd.Series) -> pd.Series:
        return score(batch).astype("float64")

    return scored


def sentence_splitter(split: Callable[[str], Iterable[str]]):
    """`splitter=` of sentences: one text to any number of sentences."""

    @F.udtf(returnType="pos: int, sentence: string")
    class Splitter:
        def eval(self, text: str):
            for pos, sentence in enumerate(split(text or "")):
                yield pos, sentence

    return Splitter


def speaker_measure(name: str, measure: Callable[[pd.Series], pd.Series], text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """`reducer=` of speaker_stats: a measure of each text, a batch of texts to a batch of
    numbers, averaged by speaker.

    Python sees batches of texts, not a speaker's whole talk, so a speaker with a third
    of all turns is spread over tasks and only sums meet.
    """

    @F.pandas_udf("double")
    def measured(batch: pd.Series) -> pd.Series:
        return measure(batch).astype("float64")

    def reduce(turns: DataFrame) -> DataFrame:
        each = turns.select("meeting_id", "speaker", measured(F.col(text)).alias("_measure"))
        return each.groupBy("meeting_id", "speaker").agg((F.round(F.avg("_measure"), 6) + F.lit(0.0)).alias(name))

    return reduce


def speaker_aggregate(
    name: str,
    init: Callable[[], object],
    update: Callable[[object, pd.Series], object],
    merge: Callable[[object, object], object],
    finish: Callable[[object], object],
    kind: str = "double",
    text: str = "text",
    keys_in_hand: int = 10_000,
) -> Callable[[DataFrame], DataFrame]:
    """`reducer=` of speaker_stats: an aggregate of the user's own over all texts of a speaker, such as a median.

    `init` makes a state, `update` takes a batch of texts into it, `merge` puts two states together, in any order, and `finish` gives
    the value, of the SQL type `kind`. A task keeps a state per speaker, for `keys_in_hand` of them at once, and
    passes it on pickled; states of one speaker are merged one after the other. So a speaker with a third of
    all turns is spread over tasks, and what meets in one is as many states as there were tasks, one at a time.
    """
    keys = ["meeting_id", "speaker"]
    value_type = to_arrow_type(StructType.fromDDL(f"value {kind}")["value"].dataType)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, object] = {}

        def states() -> pa.RecordBatch:
            rows = [(*key, pickle.dumps(state)) for key, state in held.items()]
            held.clear()
            columns = [list(column) for column in zip(*rows)] or [[], [], []]
            kinds = [pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(*each) for each in zip(columns, kinds)], [*keys, "_state"])

        for batch in batches:
            places: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*[batch.column(each).to_pylist() for each in keys])):
                places.setdefault(key, []).append(at)
            for key, rows in places.items():
                state = held[key] if key in held else init()
                held[key] = update(state, batch.column("_text").take(pa.array(rows)).to_pandas())
                if len(held) >= keys_in_hand:
                    yield states()
        yield states()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, known = None, None, False
        for batch in batches:
            done = []
            for *key, packed in zip(*[batch.column(each).to_pylist() for each in [*keys, "_state"]]):
                if known and key == own:
                    state = merge(state, pickle.loads(packed))
                    continue
                if known:
                    done.append((*own, finish(state)))
                own, state, known = key, pickle.loads(packed), True
            yield from rows_of(done)
        if known:
            yield from rows_of([(*own, finish(state))])

    def rows_of(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            columns = [list(column) for column in zip(*done)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], value_type)], [*keys, "_value"]
            )

    def reduce(turns: DataFrame) -> DataFrame:
        texts = turns.select(F.col("meeting_id").cast("long").alias("meeting_id"), "speaker", F.col(text).alias("_text"))
        states = texts.mapInArrow(partial, "meeting_id long, speaker string, _state binary")
        placed = states.repartition(*keys).sortWithinPartitions(*keys)
        return placed.mapInArrow(merged, f"meeting_id long, speaker string, _value {kind}").withColumnRenamed("_value", name)

    return reduce
