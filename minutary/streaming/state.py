"""State of a meeting while it runs.

Turns may come out of order within the delay. Each meeting keeps its turns until the
watermark has passed them and then takes them in time order, so the outcome is that of
a table sorted by time, however the turns arrived. Kept are the turns of the last
`delay` and small figures, never the whole meeting.

Processors are built inside functions, so Spark ships them to executors by value.
"""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Stateful processors need this state store; set around starting the query."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _ordered_processor(follow):
    """A processor that hands `follow` the turns in time order.

    `follow` has open(handle) to declare its state, load() and store() around a run of
    turns, place(row) to sort by, take(row, out) for one turn of (micros, turn, speaker,
    chars), and settle(passed, out) after the run, which returns a time to wake up or
    None. State is read and written once per run, since each access is a round trip to
    the JVM. Turns that arrive together wait as one row of state, in JSON, since every row has a cost
    of its own; there are never more of them than in a batch of Arrow.
    """
    from pyspark.sql.streaming import StatefulProcessor

    minute = 60_000

    class Ordered(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", "turns string")
            self.follow = follow()
            self.follow.open(handle)

        def wake_after(self, micros):
            self.handle.registerTimer((micros // 1000 // minute + 1) * minute)

        def handleInputRows(self, key, rows, timerValues):
            earliest, arrived = None, []
            for batch in rows:
                columns = [batch[name].tolist() for name in ("micros", "turn", "speaker", "chars")]
                if not columns[0]:
                    continue
                arrived.append((json.dumps(list(zip(*columns))),))
                first = min(columns[0])
                earliest = first if earliest is None else min(earliest, first)
            if earliest is not None:
                self.waiting.appendList(arrived)
                self.wake_after(earliest)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            passed = timerValues.getCurrentWatermarkInMs() * 1000
            due, rest = [], []
            for packed in self.waiting.get() if self.waiting.exists() else ():
                turns = json.loads(packed[0])
                due += [row for row in turns if row[0] < passed]
                rest.append([row for row in turns if row[0] >= passed])
            rest = [turns for turns in rest if turns]
            if due and rest:
                self.waiting.put([(json.dumps(turns),) for turns in rest])
            elif due:
                self.waiting.clear()
            out = []
            self.follow.load()
            for row in sorted(due, key=self.follow.place):
                self.follow.take(row, out)
            wake = self.follow.settle(passed, out)
            self.follow.store()
            if rest:
                self.wake_after(min(row[0] for turns in rest for row in turns))
            if wake is not None:
                self.wake_after(wake)
            if out:
                frame = pd.DataFrame(out, columns=self.follow.columns)
                frame.insert(0, "meeting_id", key[0])
                yield frame

        def close(self):
            pass

    return Ordered()


def _session_follower(gap_micros: int):
    class Session:
        columns = ["begins_micros", "last_micros", "speaker", "turns", "chars", "last_speaker"]

        def open(self, handle):
            self.span_state = handle.getValueState("span", "begins long, last long, speaker string")
            self.people_state = handle.getMapState("people", "speaker string", "turns long, chars long")

        def load(self):
            self.span = tuple(self.span_state.get()) if self.span_state.exists() else None
            self.stored = self.span is not None
            self.people = {}

        def store(self):
            if self.span is None:
                self.span_state.clear()
                return
            self.span_state.update(self.span)
            for speaker, figures in self.people.items():
                self.people_state.updateValue((speaker,), tuple(figures))

        def place(self, row):
            return row[0], row[1]

        def take(self, row, out):
            at, _, speaker, chars = row
            if self.span is not None and at - self.span[1] >= gap_micros:
                self.finish(out)
            self.span = (self.span[0] if self.span else at, at, speaker)
            if speaker not in self.people:
                known = self.stored and self.people_state.containsKey((speaker,))
                self.people[speaker] = list(self.people_state.getValue((speaker,))) if known else [0, 0]
            figures = self.people[speaker]
            figures[0] += 1
            figures[1] += chars

        def finish(self, out):
            begins, last, last_speaker = self.span
            everybody = {}
            if self.stored:
                everybody = {who[0]: tuple(figures) for who, figures in self.people_state.iterator()}
                self.people_state.clear()
            everybody.update(self.people)
            for speaker, (turns, chars) in everybody.items():
                out.append((begins, last, speaker, turns, chars, last_speaker))
            self.span, self.stored, self.people = None, False, {}

        def settle(self, passed, out):
            if self.span is None:
                return None
            silent = self.span[1] + gap_micros
            if silent <= passed:
                self.finish(out)
                return None
            return silent

    return Session


def _pair_follower(opener: str, reply: str, within_micros: int):
    class Pair:
        columns = ["turn", "opener_turn", "waited_micros"]

        def open(self, handle):
            self.opened_state = handle.getValueState("opened", "micros long, turn long")

        def load(self):
            self.opened = tuple(self.opened_state.get()) if self.opened_state.exists() else None

        def store(self):
            if self.opened is None:
                self.opened_state.clear()
            else:
                self.opened_state.update(self.opened)

        def place(self, row):
            # An opener at the same instant counts as before, whatever its number.
            return row[0], row[2] != opener, row[1]

        def take(self, row, out):
            at, turn, speaker, _ = row
            if speaker == opener:
                self.opened = (at, turn)
            elif speaker == reply and self.opened is not None and at - self.opened[0] <= within_micros:
                out.append((turn, self.opened[1], at - self.opened[0]))

        def settle(self, passed, out):
            """Once no reply can be near enough the opener is forgotten, so nothing is kept of
            meetings that have gone quiet."""
            if self.opened is None:
                return None
            over = self.opened[0] + within_micros
            if over < passed:
                self.opened = None
                return None
            return over

    return Pair


def _followed(turns: DataFrame, follow, schema: str) -> DataFrame:
    # A turn without a time has no place in the order.
    rows = turns.filter(F.col("started_at").isNotNull()).select(
        "meeting_id",
        "turn",
        "speaker",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        "started_at",
        F.unix_micros("started_at").alias("micros"),
    )
    return rows.groupBy("meeting_id").transformWithStateInPandas(
        statefulProcessor=_ordered_processor(follow),
        outputStructType=f"meeting_id long, {schema}",
        outputMode="Append",
        timeMode="EventTime",
    )


def running_minutes(turns: DataFrame, gap_seconds: int) -> DataFrame:
    """Minutes of each session, one row per speaker, given out once silence has ended
    it. Start the query inside `rocksdb_state`."""
    schema = "begins_micros long, last_micros long, speaker string, turns long, chars long, last_speaker string"
    found = _followed(turns, _session_follower(gap_seconds * 1_000_000), schema)
    return found.select(
        "meeting_id",
        F.timestamp_micros("begins_micros").alias("begins_at"),
        F.timestamp_micros("last_micros").alias("last_at"),
        "speaker",
        "turns",
        "chars",
        "last_speaker",
    )


def paired(turns: DataFrame, opener: str, reply: str, within_seconds: int) -> DataFrame:
    """Each reply with the latest opener before it; see `live.live_pairs`."""
    wanted = turns.filter(F.col("speaker").isin(opener, reply))
    follow = _pair_follower(opener, reply, within_seconds * 1_000_000)
    return _followed(wanted, follow, "turn long, opener_turn long, waited_micros long")
