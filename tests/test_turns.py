"""Reading, checking, shaping and joining, on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from turn_rows import at
from minutary.functions import hooks
from minutary.operators import joins, shaping, talk
from minutary.sources import checks, sinks, transcripts


def test_formats_read_alike(spark, make_turns, rows, tmp_path):
    turns = make_turns((1, 0, "ann", 'a "quoted", word', "10:00:00", "10:00:05"), (1, 1, "bob", "b", "10:00:05"))
    for fmt in ("parquet", "json", "csv", "orc"):
        path = str(tmp_path / fmt)
        writer = turns.write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", "true").option("escape", '"')
        if fmt == "parquet":
            stored = turns.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("started_at", "ended_at")})
            writer = stored.write.format(fmt)
        writer.save(path)
        assert rows(transcripts.read_turns(spark, path, fmt)) == rows(turns), fmt


def test_csv_goes_by_the_names_in_its_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("turn,meeting_id,speaker,text\n7,1,ann,hello\nx,2,bob,\n")
    found = sorted(map(tuple, transcripts.read_turns(spark, str(path), "csv").collect()))
    assert found == [(1, 7, "ann", "hello", None, None), (2, None, "bob", None, None, None)]
    path.write_text("turn,meeting,speaker,text\n7,1,ann,hello\n")
    with pytest.raises(ValueError):
        transcripts.read_turns(spark, str(path), "csv")


def test_handoffs_to_speakers_without_a_column(make_turns, rows):
    turns = make_turns((1, 0, "a", "x"), (1, 1, "b", "x"), (1, 2, "c", "x"), (1, 3, "b", "x"), (1, 4, None, "x"))
    wide = talk.handoffs(turns, wide=["b"])
    assert rows(wide, "from_speaker", "b", "others") == [("a", 1, None), ("b", None, 2), ("c", 1, None)]


def test_mapping_leaves_missing_columns_null(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(7, 0, "x", "hi")], "room long, n long, who string, said string").write.json(path)
    mapping = {"meeting_id": "room", "turn": "n", "speaker": "who", "text": "said"}
    assert tuple(transcripts.read_turns(spark, path, "json", mapping).first()) == (7, 0, "x", "hi", None, None)


@pytest.fixture
def bad(make_turns):
    return make_turns(
        (1, 0, "ann", "hello"),
        (1, 1, "ann", "twice"),
        (1, 1, None, " "),
        (1, 2, None, "  "),
        (1, 3, None, "no speaker"),
        (1, 6, "bob", "after a gap"),
        (1, 7, "bob", None),
        (1, None, "ann", "when?"),
        (None, None, "ann", "where?"),
        (2, 4, "ann", "starts late"),
        (2, 5, "ann", "goes on"),
    )


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_checks(bad, rows, block):
    clean, rejects = checks.check_turns(bad, block)
    assert rows(rejects, "turn", "reason") == sorted(
        [(1, "duplicate key"), (1, "duplicate key"), (2, "blank text"), (3, "null speaker"), (7, "blank text")]
        + [(None, "missing key")] * 2,
        key=repr,
    )
    assert rows(clean, "meeting_id", "turn", "missing_before") == [(1, 0, 0), (1, 6, 5), (2, 4, 0), (2, 5, 0)]


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_stitch(make_turns, rows, block):
    turns = make_turns(
        (1, 0, "ann", "a"), (1, 1, "ann", "b"), (1, 2, "bob", "c"), (1, 3, "ann", "d"), (1, 5, "ann", "e"),
        (1, 6, "ann", "f"), (2, 0, "ann", "g"),
    )
    whole = shaping.stitch_turns(turns, block_turns=block)
    assert rows(whole, "meeting_id", "turn", "piece", "speaker", "turns", "text") == [
        (1, 0, 0, "ann", 2, "a\nb"),
        (1, 2, 0, "bob", 1, "c"),
        (1, 3, 0, "ann", 3, "d\ne\nf"),
        (2, 0, 0, "ann", 1, "g"),
    ]
    pieces = shaping.stitch_turns(turns, piece_turns=2, block_turns=block)
    assert rows(pieces.filter("turn = 3"), "piece", "text") == [(0, "d\ne"), (1, "f")]


def test_sentences_and_words(make_turns, rows):
    turns = make_turns((1, 0, "ann", "Hi there!! How are you?\n\n  Fine. "), (1, 1, "ann", "..."))
    assert rows(shaping.sentences(turns), "turn", "pos", "sentence") == [
        (0, 0, "Hi there"),
        (0, 1, "How are you"),
        (0, 2, "Fine"),
    ]
    assert [r.word for r in shaping.tokens(make_turns((1, 0, "a", "L'été: 3 Äpfel"))).collect()] == ["l", "été", "äpfel"]


def test_sentences_keep_every_letter(spark, sf):
    from minutary import catalog

    turns = catalog.talk_of(spark, sf)
    kept = F.regexp_replace(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).sentence, ""), r"[\s.!?]", "")
    found = shaping.sentences(turns).groupBy("meeting_id", "turn").agg(kept.alias("kept"))
    both = turns.join(found, ["meeting_id", "turn"])
    assert both.count() == turns.count()
    assert both.filter(F.regexp_replace("text", r"[\s.!?]", "") != F.col("kept")).count() == 0


def test_user_splitter(make_turns, rows):
    splitter = hooks.sentence_splitter(lambda text: text.split(";"))
    found = shaping.sentences(make_turns((1, 0, "ann", "a;b"), (1, 1, "bob", None)), splitter=splitter)
    assert rows(found, "turn", "pos", "sentence") == [(0, 0, "a"), (0, 1, "b"), (1, 0, "")]


def test_select_turns(make_turns, rows):
    turns = make_turns((1, 0, "ann", "red apple"), (1, 1, "bob", "red"), (1, 2, "ann", "blue"))
    assert shaping.select_turns(turns).count() == 3
    assert rows(shaping.select_turns(turns, ["ann"], "red", 4), "turn") == [(0,)]


def test_roster(spark, make_turns, rows):
    turns = make_turns((1, 0, "ann", "x"), (1, 1, "eve", "y"))
    roster = spark.createDataFrame(
        [(1, "ann", "Ann A.", "chair"), (1, "bob", "Bob B.", "member")],
        "meeting_id long, speaker string, name string, role string",
    )
    assert rows(joins.roster_join(turns, roster, "left"), "turn", "name") == [(0, "Ann A."), (1, None)]
    assert rows(joins.roster_join(turns, roster, "semi"), "turn") == [(0,)]
    assert rows(joins.roster_join(turns, roster, "anti"), "turn") == [(1,)]
    assert rows(joins.absentees(turns, roster), "name") == [("Bob B.",)]


@pytest.mark.parametrize("limit", [1, 2, 1000])
def test_agenda(spark, make_turns, rows, limit):
    turns = make_turns(
        (1, 0, "a", "early", "09:59:59"), (1, 1, "a", "on time", "10:00:00"), (1, 2, "a", "later", "10:30:00"),
        (1, 3, "a", "no time"), (2, 0, "a", "no agenda", "10:00:00"),
    )
    agenda = spark.createDataFrame(
        [(1, 1, "one", at("10:00:00")), (1, 2, "two", at("10:00:00")), (1, 3, "three", at("10:20:00"))],
        "meeting_id long, item long, title string, starts_at timestamp",
    )
    assert rows(joins.agenda_asof(turns, agenda, limit), "meeting_id", "turn", "title") == sorted(
        [(1, 0, None), (1, 1, "two"), (1, 2, "three"), (1, 3, None), (2, 0, None)], key=repr
    )


@pytest.mark.parametrize("limit", [1, 2, 1000])
def test_interruptions(make_turns, rows, limit):
    turns = make_turns(
        (1, 0, "ann", "", "10:00:00", "10:01:00"),
        (1, 1, "bob", "", "10:00:30", "10:00:40"),
        (1, 2, "ann", "", "10:00:35", "10:00:36"),
        (1, 3, "bob", "", "10:01:00", "10:01:00"),
        (1, 4, "eve", "", "10:00:00", "10:00:30"),
        (2, 0, "bob", "", "10:00:10", "10:00:20"),
    )
    # Turn 3 starts as turn 0 ends, turns 0 and 4 start together: neither is inside.
    assert rows(joins.interruptions(turns, limit), "meeting_id", "turn", "interruptions") == [
        (1, 0, 1),
        (1, 1, 1),
        (1, 2, 0),
        (1, 3, 0),
        (1, 4, 0),
        (2, 0, 0),
    ]


def test_shares_add_up(spark, sf):
    from minutary import catalog

    sums = talk.speaker_stats(catalog.talk_of(spark, sf)).groupBy("meeting_id").agg(F.sum("share").alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1) > 1e-5).count() == 0


def test_balance(make_turns, rows):
    turns = make_turns((1, 0, "a", ""), (1, 1, "b", ""), (2, 0, "a", ""), (2, 1, "a", ""))
    assert rows(talk.balance(turns), "meeting_id", "evenness") == [(1, 0.693147), (2, 0.0)]


def test_measure_of_speakers(make_turns, rows):
    turns = make_turns((1, 0, "a", "x!"), (1, 1, "a", "y"), (1, 2, "b", "!!"))
    reducer = hooks.speaker_measure("shouts", lambda texts: texts.str.count("!"))
    assert rows(talk.speaker_stats(turns, reducer), "speaker", "shouts") == [("a", 0.5), ("b", 2.0)]


def test_write_replaces_only_what_it_holds(spark, rows, tmp_path):
    path = str(tmp_path / "minutes")
    first = sinks.with_bucket(spark.range(100).withColumnRenamed("id", "meeting_id"), ["meeting_id"], 4).withColumn("v", F.lit(1))
    sinks.write_minutes(first, path, ["bucket"])
    second = first.filter("bucket = 2").withColumn("v", F.lit(2))
    for _ in range(2):
        sinks.write_minutes(second, path, ["bucket"])
    found = spark.read.parquet(path)
    assert found.count() == 100
    assert rows(found.filter("v = 2"), "meeting_id") == rows(second, "meeting_id")


def test_sketches_of_lengths_merge(make_turns):
    """Of 3,000 lengths in 60 meetings, each as its own sketch."""
    turns = make_turns(*[(n % 60, n, "a", "x" * (n * 7919 % 3000)) for n in range(3000)], (99, 1, "a", None))
    sketches = talk.length_sketches(turns)
    merged = talk.merged_lengths(sketches, [0.1, 0.5, 0.9]).first()
    assert merged.turns == 3000
    for share, found in zip([0.1, 0.5, 0.9], [merged.q0, merged.q1, merged.q2]):
        assert abs(found / 3000 - share) <= 0.03
    by = talk.merged_lengths(sketches, [0.5], (F.col("meeting_id") % 2).alias("odd"))
    assert {row.odd: row.turns for row in by.collect()} == {0: 1500, 1: 1500}
