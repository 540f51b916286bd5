"""Random meetings, full of ties and overlaps, against plain loops in Python."""

import datetime as dt
import random

import pytest

from turn_rows import TURN
from minutary.operators import joins, shaping, topics
from minutary.streaming import live

START = dt.datetime(2024, 5, 6, 10)


def meetings(seed: int, count: int = 60):
    """Turns of a few meetings; the first has half of them. Few different times, so
    many are equal."""
    pick = random.Random(seed)
    found, used = [], set()
    for _ in range(count):
        meeting = pick.choice([1, 1, 1, 2, 3])
        turn = pick.randrange(200)
        if (meeting, turn) in used:
            continue
        used.add((meeting, turn))
        begun = START + dt.timedelta(seconds=pick.randrange(40))
        ended = begun + dt.timedelta(seconds=pick.randrange(8))
        words = " ".join(pick.choice(["red", "green", "blue"]) for _ in range(pick.randrange(4)))
        found.append((meeting, turn, pick.choice("ab"), words, begun, ended))
    return found


@pytest.fixture(params=[1, 2])
def data(request):
    return meetings(request.param)


@pytest.fixture
def turns(spark, data):
    return spark.createDataFrame(data, TURN)


def test_interruptions(turns, data, rows):
    expected = [
        (m, t, sum(1 for n, _, other, _, at, _ in data if n == m and other != who and begun < at < ended))
        for m, t, who, _, begun, ended in data
    ]
    for limit in (7, 1000):
        assert rows(joins.interruptions(turns, limit), "meeting_id", "turn", "interruptions") == sorted(expected, key=repr)


def test_pairs(turns, data, rows):
    expected = []
    for m, t, who, _, begun, _ in data:
        openers = [(at, o) for n, o, other, _, at, _ in data if n == m and other == "a" and at <= begun]
        if who == "b" and openers and (begun - max(openers)[0]).seconds <= 2:
            expected.append((m, t, max(openers)[1]))
    for limit in (7, 1000):
        found = live.live_pairs(turns, "a", "b", 2, limit)
        assert rows(found, "meeting_id", "turn", "opener_turn") == sorted(expected, key=repr)


def test_sessions(turns, data, rows):
    expected = []
    for m in {row[0] for row in data}:
        times = sorted(row[4] for row in data if row[0] == m)
        groups = [[times[0]]]
        for before, now in zip(times, times[1:]):
            if (now - before).seconds >= 2:
                groups.append([])
            groups[-1].append(now)
        expected += [(m, group[0], len(group)) for group in groups]
    for limit in (7, 1000):
        found = live.live_sessions(turns, 2, limit)
        assert rows(found, "meeting_id", "begins_at", "turns") == sorted(expected, key=repr)


def test_stretches(turns, data, rows):
    expected = []
    for m in {row[0] for row in data}:
        first = place = speaker = None
        for _, t, who, *_ in sorted(row for row in data if row[0] == m):
            first, place = (t, 0) if who != speaker else (first, place + 1)
            speaker = who
            expected.append((m, t, first, place))
    for block in (1, 10, 1000):
        found = shaping.stretches(turns, block)
        assert rows(found, "meeting_id", "turn", "first_turn", "place") == sorted(expected, key=repr)


def test_cosines(turns, data, rows):
    def counts(text):
        return {word: text.split().count(word) for word in text.split()}

    expected = []
    for m in {row[0] for row in data}:
        mine = sorted(row for row in data if row[0] == m)
        for (_, _, _, one, *_), (_, t, _, two, *_) in zip(mine, mine[1:]):
            a, b = counts(one), counts(two)
            size = (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
            expected.append((m, t, round(sum(a[w] * b.get(w, 0) for w in a) / size, 5) if size else 0.0))
    for block in (10, 1000):
        found = [(m, t, round(c, 5)) for m, t, c in rows(topics.turn_cosines(turns, block))]
        assert sorted(found, key=repr) == sorted(expected, key=repr)
