"""Streams fed file by file."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from turn_rows import at
from minutary.streaming import feeds, live, sinks, state

MAPPING = {name: name for name in ("meeting_id", "turn", "speaker", "text", "started_at")}


class Feed:
    """A folder of JSON files, a stream over it and the table it fills."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.parts = spark, folder, 0
        os.makedirs(folder / "in")

    def add(self, *turns):
        """One file of (meeting, turn, speaker, text, clock)."""
        path = self.folder / "in" / f"{self.parts:03}.json"
        lines = [dict(zip(MAPPING, (*row[:4], f"2024-05-06T{row[4]}Z"))) for row in turns]
        path.write_text("".join(json.dumps(line) + "\n" for line in lines))
        os.utime(path, (1_700_000_000 + self.parts,) * 2)
        self.parts += 1

    def turns(self, delay="10 minutes"):
        return feeds.stream_turns(self.spark, str(self.folder / "in"), delay, "json", MAPPING, files_per_trigger=1)

    def run(self, stream):
        with state.rocksdb_state(self.spark):
            feeds.drain_to_table(stream, str(self.folder / "out"), str(self.folder / "checkpoint"))
        return self.spark.read.schema(stream.schema).parquet(str(self.folder / "out"))

    def for_each(self, stream, handler):
        query = (
            stream.writeStream.foreachBatch(handler)
            .option("checkpointLocation", str(self.folder / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


@pytest.fixture
def talk(make_turns):
    return make_turns


TALK = [
    [(1, 0, "ann", "one", "10:00:00"), (1, 2, "ann", "three", "10:04:00"), (2, 0, "eve", "a", "10:00:00")],
    # Out of order but inside the delay.
    [(1, 1, "bob", "two", "10:02:00"), (2, 1, "eve", "b", "10:10:00")],
    # Meeting 1 comes back after more than half an hour: a new turn ends the silence.
    [(1, 3, "bob", "back", "10:34:00"), (2, 2, "ann", "c", "10:20:00")],
    # Others go on, so only time can end meeting 1.
    [(3, 0, "zoe", "far", "12:00:00")],
    [(3, 1, "zoe", "farther", "12:05:00")],
    [(3, 2, "zoe", "farthest", "14:00:00")],
    [(3, 3, "zoe", "end", "14:01:00")],
]

ENDED = [
    (1, at("10:00:00"), at("10:04:00"), "ann", 2, 8, "ann"),
    (1, at("10:00:00"), at("10:04:00"), "bob", 1, 3, "ann"),
    (1, at("10:34:00"), at("10:34:00"), "bob", 1, 4, "bob"),
    (2, at("10:00:00"), at("10:20:00"), "ann", 1, 1, "ann"),
    (2, at("10:00:00"), at("10:20:00"), "eve", 2, 2, "ann"),
    (3, at("12:00:00"), at("12:05:00"), "zoe", 2, 10, "zoe"),
]


def test_running_minutes(feed, rows, make_turns):
    for part in TALK:
        feed.add(*part)
    assert rows(feed.run(state.running_minutes(feed.turns(), 1800))) == sorted(ENDED, key=repr)
    everything = make_turns(*[row for part in TALK for row in part])
    closed = live.session_minutes(everything, 1800).filter("last_at < '2024-05-06 14:00:00'")
    columns = ["meeting_id", "begins_at", "last_at", "speaker", "turns", "chars", "last_speaker"]
    assert rows(closed, *columns) == sorted(ENDED, key=repr)


def test_running_minutes_after_a_restart(feed, rows):
    for part in TALK:
        feed.add(*part)
        found = feed.run(state.running_minutes(feed.turns(), 1800))
    assert rows(found) == sorted(ENDED, key=repr)


def test_sessions_agree_with_table(feed, rows, make_turns):
    for part in TALK:
        feed.add(*part)
    found = rows(feed.run(live.live_sessions(feed.turns(), 1800)))
    table = make_turns(*[row for part in TALK for row in part])
    whole = live.live_sessions(table, 1800)
    # A gap of exactly the limit starts a new session in both: meeting 1 at 10:34.
    assert (1, at("10:34:00"), at("11:04:00"), 1) in found
    assert found == rows(whole.filter("ends_at <= '2024-05-06 13:51:00'"), *["meeting_id", "begins_at", "ends_at", "turns"])


def test_windows_agree_with_table(feed, rows, make_turns):
    for part in TALK:
        feed.add(*part)
    found = rows(feed.run(live.live_sliding(feed.turns(), "10 minutes", "5 minutes")))
    whole = live.live_sliding(make_turns(*[row for part in TALK for row in part]), "10 minutes", "5 minutes")
    assert found == rows(whole.filter("ends_at <= '2024-05-06 13:51:00'"))


def test_replays_are_dropped(feed, rows):
    feed.add((1, 0, "ann", "x", "10:00:00"), (1, 0, "ann", "x", "10:00:00"))
    feed.add((1, 0, "ann", "x", "10:00:00"), (1, 1, "bob", "y", "10:01:00"))
    found = feed.run(live.drop_replays(feed.turns(), ["meeting_id", "turn"]))
    assert rows(found, "turn", "text") == [(0, "x"), (1, "y")]


def test_names_join_a_stream(spark, feed, rows):
    feed.add((1, 0, "ann", "x", "10:00:00"), (1, 1, "eve", "y", "10:01:00"))
    roster = spark.createDataFrame([(1, "ann", "Ann A.", "chair")], "meeting_id long, speaker string, name string, role string")
    assert rows(feed.run(live.live_roster(feed.turns(), roster)), "turn", "name") == [(0, "Ann A."), (1, None)]


PAIRS = [
    [(1, 0, "ask", "", "10:00:00"), (1, 3, "tell", "", "10:05:00"), (1, 9, "ask", "", "10:05:00")],
    [(1, 2, "ask", "", "10:04:00"), (1, 4, "tell", "", "10:20:00"), (1, 5, "other", "", "10:06:00")],
    [(2, 0, "tell", "", "10:30:00"), (1, 6, "tell", "", "10:40:00")],
    [(3, 0, "other", "", "13:00:00"), (3, 1, "ask", "", "13:00:00")],
    [(3, 2, "ask", "", "13:01:00")],
]


def test_pairs_agree_with_table(feed, rows, make_turns):
    for part in PAIRS:
        feed.add(*part)
    found = rows(feed.run(live.live_pairs(feed.turns("30 minutes"), "ask", "tell", 1200)))
    # Turn 9 is at the same time as turn 3 and counts as before it; turn 6 waits too long.
    assert found == [(1, 3, 9, 0), (1, 4, 9, 900_000_000)]
    assert rows(live.live_pairs(make_turns(*[row for part in PAIRS for row in part]), "ask", "tell", 1200)) == found


def test_late_rows_go_aside(spark, feed, rows):
    feed.add((1, 0, "a", "", "10:00:00"))
    feed.add((1, 1, "a", "", "11:00:00"), (1, 2, "a", "", "09:55:00"))
    feed.add((1, 3, "a", "", "10:00:00"), (1, 4, "a", "", "10:51:00"))
    path = str(feed.folder / "split")
    handler = sinks.split_late(path, 600)
    feed.for_each(feed.turns(), handler)
    assert rows(spark.read.parquet(f"{path}/late"), "turn", "batch_id") == [(3, 2)]
    assert rows(spark.read.parquet(f"{path}/ontime"), "turn") == [(0,), (1,), (2,), (4,)]
    # The last batch again, as after a failure.
    again = feeds.as_turns(spark.read.schema(feed.turns().schema).json(str(feed.folder / "in/002.json")))
    handler(again, 2)
    assert rows(spark.read.parquet(f"{path}/late"), "turn", "batch_id") == [(3, 2)]
    assert spark.read.parquet(f"{path}/ontime").count() == 4


def test_upsert_keeps_the_newest(spark, feed, rows):
    path = str(feed.folder / "latest")
    handler = sinks.upsert_sink(path, ["meeting_id", "speaker"], ["started_at", "turn"], 4)
    feed.add((1, 0, "a", "old", "10:00:00"), (1, 1, "a", "new", "10:01:00"), (2, 0, "b", "kept", "10:00:00"))
    feed.add((1, 2, "a", "newest", "10:02:00"), (1, 3, "c", "first", "10:02:00"))
    feed.add((1, 4, "a", "late", "10:00:30"))
    feed.for_each(feed.turns(), handler)
    expected = [(1, "a", "newest"), (1, "c", "first"), (2, "b", "kept")]
    assert rows(spark.read.parquet(path), "meeting_id", "speaker", "text") == expected
    again = feeds.as_turns(spark.read.schema(feed.turns().schema).json(str(feed.folder / "in/001.json")))
    handler(again, 1)
    assert rows(spark.read.parquet(path), "meeting_id", "speaker", "text") == expected


def test_turns_without_a_time_are_set_aside(spark, feed):
    feed.add((1, 0, "ann", "one", "10:00:00"), (1, 1, "bob", "two", "10:02:00"))
    path = feed.folder / "in" / "000.json"
    path.write_text(path.read_text() + json.dumps({"meeting_id": 1, "turn": 9, "speaker": "ann", "text": "no time"}) + "\n")
    os.utime(path, (1_700_000_000,) * 2)
    for turn, clock in enumerate(("18:00:00", "19:00:00", "20:00:00", "21:00:00")):
        feed.add((2, turn, "zoe", "far", clock))
    found = feed.run(state.running_minutes(feed.turns(), 1800)).filter("meeting_id = 1")
    assert sorted((r.speaker, r.turns) for r in found.collect()) == [("ann", 1), ("bob", 1)]


def test_pairs_forget_openers_that_no_reply_can_reach():
    class Value:
        def __init__(self):
            self.held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        def getValueState(self, name, schema):
            return value

    value = Value()
    follow = state._pair_follower("open", "reply", 100)()
    follow.open(Handle())
    follow.load()
    follow.take((10, 0, "open", 0), [])
    assert follow.settle(50, []) == 110
    follow.store()
    assert value.held == (10, 0)
    follow.load()
    assert follow.settle(111, []) is None
    follow.store()
    assert value.held is None


def test_upsert_leaves_only_its_table(spark, tmp_path, make_turns):
    from minutary.session import shared_dir

    handler = sinks.upsert_sink(str(tmp_path / "table"), ["meeting_id", "speaker"], ["turn"], 2)

    def folders():
        return len(os.listdir(shared_dir(spark).removeprefix("file:")))

    before = folders()
    for number in range(4):
        handler(make_turns((1, number, "ann", "x"), (2, number, "bob", "y")), number)
    assert folders() == before
    assert sorted((r.meeting_id, r.turn) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [(1, 3), (2, 3)]


def test_marks_of_lateness_do_not_pile_up(spark, tmp_path, make_turns):
    handler = sinks.split_late(str(tmp_path), 60)
    clocks = ["10:00:00", "10:10:00", None, "10:09:30", "10:08:00", "10:20:00"]
    for number, clock in enumerate(clocks):
        for _ in range(2):
            handler(make_turns((1, number, "ann", "x", clock)), number)
    assert len([name for name in os.listdir(tmp_path / "marks") if name.startswith("batch_id=")]) == 2
    late = spark.read.parquet(str(tmp_path / "late"))
    assert [r.turn for r in late.collect()] == [4]
    assert spark.read.parquet(str(tmp_path / "ontime")).count() == 5


def test_turns_that_arrive_together_wait_as_one_row():
    """Rows of state are what costs; the outcome does not depend on how turns arrive."""
    import pandas as pd

    class Listed(list):
        appendList, exists, get = list.extend, lambda self: bool(self), lambda self: iter(list(self))

        def put(self, rows):
            self[:] = rows

    class Handle:
        def getListState(self, name, schema):
            return Listed()

        def registerTimer(self, millis):
            pass

    class Follow:
        columns = ["turn", "speaker"]
        open = load = store = lambda self, *handle: None

        def place(self, row):
            return row[0], row[1]

        def take(self, row, out):
            out.append((row[1], row[2]))

        def settle(self, passed, out):
            return None

    class Clock:
        def getCurrentWatermarkInMs(self):
            return self.now

    rows = pd.DataFrame({"micros": range(0, 90_000, 1000), "turn": range(90), "speaker": ["änn", None, '"eve"'] * 30, "chars": [1] * 90})
    kept = state._ordered_processor(Follow)
    kept.init(Handle())
    list(kept.handleInputRows((1,), iter([rows[:30], rows[:0], rows[30:]]), None))
    assert len(kept.waiting) == 2
    clock, found = Clock(), []
    for clock.now in (40, 40, 1000):
        for frame in kept.handleExpiredTimer((1,), clock, None):
            found.append(frame)
    assert [len(frame) for frame in found] == [40, 50] and not kept.waiting
    assert list(zip(*[pd.concat(found)[name].tolist() for name in Follow.columns])) == list(zip(rows.turn.tolist(), rows.speaker.tolist()))
