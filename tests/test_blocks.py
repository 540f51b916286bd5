"""Ordered operators give the same however the order is cut into blocks."""

import pytest

from minutary import catalog
from minutary.operators import joins, ordering, shaping, talk, terms, topics
from minutary.plans import minutes
from minutary.streaming import live

BY_TURN = {
    "stretches": lambda t, n: shaping.stretches(t, n),
    "handoffs": lambda t, n: talk.handoffs(t, block_turns=n),
    "turn_flow": lambda t, n: talk.turn_flow(t, n),
    "turn_cosines": lambda t, n: topics.turn_cosines(t, n),
}


@pytest.mark.parametrize("name", BY_TURN)
def test_by_turn(spark, sf, rows, name):
    turns = catalog.talk_of(spark, sf)
    whole = rows(BY_TURN[name](turns, 1 << 16))
    assert rows(BY_TURN[name](turns, 2)) == whole
    assert rows(BY_TURN[name](turns, 1)) == whole


BY_TIME = {
    "sessions": lambda t, n: live.live_sessions(t, 3600, n),
    "pairs": lambda t, n: live.live_pairs(t, "click", "purchase", 6 * 3600, n),
    "session_minutes": lambda t, n: live.session_minutes(t, 3600, n),
}


@pytest.mark.parametrize("name", BY_TIME)
def test_by_time(spark, sf, rows, name):
    turns = catalog.activity_of(spark, sf)
    assert rows(BY_TIME[name](turns, 40)) == rows(BY_TIME[name](turns, 1 << 20))


def test_interruptions_by_time(spark, sf, rows):
    turns = catalog.timed_of(spark, sf)
    assert rows(joins.interruptions(turns, 100)) == rows(joins.interruptions(turns))


def test_threads(spark, sf, rows):
    best = terms.key_terms(catalog.talk_of(spark, sf), 3)
    assert rows(topics.topic_threads(best, 2)) == rows(topics.topic_threads(best))


def test_one_meeting_and_one_instant_are_split(spark):
    """All rows in one meeting at one time still end up in several blocks."""
    rows = spark.range(20000).selectExpr("1L AS meeting_id", "id AS turn", "timestamp'2024-01-01' AS started_at")
    placed = ordering.block_by_range(rows, ["meeting_id"], ["started_at", "turn"], limit=2500)
    sizes = [r["count"] for r in placed.groupBy(ordering.BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 20000 / 3


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_segments_counted_in_order(make_turns, spark, rows, block):
    turns = make_turns(*[(m, t, "a", "x") for m in (1, 2) for t in range(6)])
    shifts = spark.createDataFrame([(1, 2), (1, 5)], "meeting_id long, turn long")
    expected = [(1, t, (t >= 2) + (t >= 5)) for t in range(6)] + [(2, t, 0) for t in range(6)]
    assert rows(topics.number_segments(turns, shifts, block), "meeting_id", "turn", "segment") == expected


def test_gaps_in_turn_numbers(make_turns, rows):
    turns = make_turns((1, 0, "a", "red red blue"), (1, 4, "b", "red"), (1, 5, "a", "green"), (2, 3, "a", "red"))
    for block in (1, 3, 100):
        assert rows(topics.turn_cosines(turns, block)) == [(1, 4, 0.894427), (1, 5, 0.0)]


def test_parts_hold_the_whole_meeting(spark, sf):
    turns = catalog.talk_of(spark, sf)
    whole = minutes.assemble_minutes(turns)
    parts = minutes.assemble_minutes(turns, part_turns=2)
    assert parts.count() > whole.count()

    def flat(built, section, fields):
        return sorted(
            (r.meeting_id, *[e[f] for f in fields]) for r in built.collect() for e in (getattr(r, section) or [])
        )

    for section, fields in {
        "speakers": ["speaker", "turns", "share"],
        "items": ["item_id", "sentence"],
        "key_terms": ["rank", "term"],
        "topics": ["segment", "first_turn"],
        "summary": ["turn", "pos", "sentence"],
    }.items():
        assert flat(whole, section, fields) == flat(parts, section, fields), section
    assert all(len(r.speakers or []) <= 2 for r in parts.collect())


def test_gaps_in_numbers_make_no_parts(make_turns):
    turns = make_turns((1, 0, "a", "red will"), (1, 2000, "b", "blue"), (1, 5000, "a", "we agreed"), (None, 7, "a", "who"))
    whole = minutes.assemble_minutes(turns)
    assert sorted(((r.meeting_id, r.part, r.turns) for r in whole.collect()), key=repr) == [(1, 0, 3), (None, 0, 1)]
    cut = minutes.assemble_minutes(turns, part_turns=2, block_turns=1000)
    assert sorted(((r.meeting_id, r.part, r.turns) for r in cut.collect()), key=repr) == [(1, 0, 2), (1, 1, 1), (None, 0, 1)]
    lines = minutes.render_lines(minutes.minutes_tables(turns)).filter("meeting_id = 1").orderBy("section", "place", "pos", "text").collect()
    assert [row.text for row in lines if row.section in (0, 1, 5)] == [
        "# Meeting 1", "- a: 2 turns", "- b: 1 turns", "- action: red will", "- decision: we agreed",
    ]


def test_partition_count_changes_nothing(spark, sf, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    turns = catalog.talk_of(spark, sf)
    one = rows(minutes.assemble_minutes(turns), "meeting_id", "part", "version")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows(minutes.assemble_minutes(turns), "meeting_id", "part", "version") == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("limit", [1 << 20, 5, 2])
def test_interruptions_without_speakers_at_any_limit(make_turns, rows, limit):
    spans = [(1, t, None if t % 3 == 0 else "ab"[t % 2], "x", f"10:{t:02}:00", f"10:{t + 3:02}:30") for t in range(12)]
    found = rows(joins.interruptions(make_turns(*spans), limit), "turn", "interruptions")
    expected = [
        (t, sum(u != t and t < u <= t + 3 and u % 3 != 0 and u % 2 != t % 2 for u in range(12)) if t % 3 else 0) for t in range(12)
    ]
    assert found == sorted(expected, key=repr)


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_null_keys_stay(make_turns, rows, block):
    turns = make_turns((None, 0, "a", "x"), (None, 1, "a", "yy"), (1, 0, None, "z"), (1, None, "b", "w"))
    stitched = shaping.stitch_turns(turns, block_turns=block)
    assert rows(stitched, "meeting_id", "speaker", "turns", "text") == sorted(
        [(None, "a", 2, "x\nyy"), (1, None, 1, "z"), (1, "b", 1, "w")], key=repr
    )
    assert talk.turn_flow(turns, block).count() == 4


def test_a_repeated_turn_does_not_cancel_a_gap(make_turns, rows):
    turns = make_turns((1, 0, "a", "red blue"), (1, 2, "b", "red"), (1, 2, "b", ""))
    assert rows(topics.turn_cosines(turns)) == [(1, 2, 0.707107)]
