"""Key terms, summaries, items, search, publishing: small cases by hand."""

import datetime as dt
import math
import time

import pytest
from pyspark.sql import functions as F

from turn_rows import at
from minutary.functions import cues, hooks
from minutary.operators import items, publishing, search, shaping, talk, terms, topics
from minutary.plans import minutes


def test_key_terms(make_turns, rows):
    turns = make_turns((1, 0, "a", "budget budget the"), (2, 0, "a", "the hall"), (3, 0, "a", "..."))
    ln3, ln15 = round(math.log(3), 6), round(math.log(1.5), 6)
    assert rows(terms.key_terms(turns, 2), "meeting_id", "rank", "term", "weight") == [
        (1, 1, "budget", round(2 * math.log(3), 6)),
        (1, 2, "the", ln15),
        (2, 1, "hall", ln3),
        (2, 2, "the", ln15),
    ]


def test_phrases_stay_inside_a_turn(make_turns, rows):
    turns = make_turns((1, 0, "a", "one two three"), (1, 1, "a", "four"), (2, 0, "a", "x y"))
    assert rows(terms.term_weights(turns, 2), "term") == [("one two",), ("two three",), ("x y",)]
    assert rows(terms.term_weights(turns, 3), "term") == [("one two three",)]


def test_summary_skips_short_sentences_and_takes_a_scorer(make_turns, rows):
    turns = make_turns((1, 0, "a", "rare words here. no. common common common"), (2, 0, "a", "common common common"))
    assert rows(terms.key_sentences(turns, 5).filter("meeting_id = 1"), "place", "pos", "sentence") == [
        (1, 0, "rare words here"),
        (2, 2, "common common common"),
    ]
    longest = hooks.sentence_scorer(lambda batch: batch.str.len())
    assert rows(terms.key_sentences(turns, 1, scorer=longest), "meeting_id", "pos", "score") == [(1, 2, 20.0), (2, 0, 20.0)]


def test_central_sentence(make_turns, rows):
    turns = make_turns((1, 0, "a", "red blue. red green. red. grey"))
    found = rows(terms.central_sentences(turns, 2), "place", "sentence", "centrality")
    assert found == [(1, "red", round(2 / math.sqrt(2) / 3, 6)), (2, "red blue", round((0.5 + 1 / math.sqrt(2)) / 3, 6))]


def test_shifts_count_turns_without_words(make_turns, rows):
    turns = make_turns((1, 0, "a", "red"), (1, 1, "a", "red"), (1, 2, "a", "..."), (1, 3, "a", None))
    assert rows(topics.turn_cosines(turns)) == [(1, 1, 1.0), (1, 2, 0.0), (1, 3, 0.0)]


LEXICON = [
    cues.Cue("action", "en", "will|todo"),
    cues.Cue("decision", "en", "agreed"),
    cues.Cue("decision", "de", "beschlossen"),
    cues.Cue("question", "en", "who"),
    cues.Cue("done", "en", "done"),
]


@pytest.fixture
def cued(spark):
    return spark.createDataFrame(
        [
            (1, 0, 0, "We agreed that Ann will write by 2024-06-01"),
            (1, 0, 1, "Nothing here, willing or whole"),
            (1, 1, 0, "Es ist BESCHLOSSEN"),
            (1, 1, 1, "Ann will call until 2024-02-30"),
            (1, 2, 0, "Owner: Bob, todo"),
            (1, 2, 1, "who? done"),
        ],
        "meeting_id long, turn long, pos int, sentence string",
    )


def test_cues(cued, rows):
    spoken = cued.selectExpr("*", "if(turn = 1 AND pos = 0, 'de', 'en') AS lang")
    assert rows(items.cue_items(cued, LEXICON, lang="de"), "turn", "pos") == [(1, 0)]
    found = items.cue_items(spoken, LEXICON)
    assert rows(found, "turn", "pos", "kind") == [
        (0, 0, "action"),
        (0, 0, "decision"),
        (1, 0, "decision"),
        (1, 1, "action"),
        (2, 0, "action"),
        (2, 1, "done"),
        (2, 1, "question"),
    ]
    assert found.select("item_id").distinct().count() == 7


def test_fields(cued, rows):
    found = items.item_fields(cued)
    assert rows(found, "turn", "pos", "owner", "due") == sorted(
        [
            (0, 0, None, dt.date(2024, 6, 1)),
            (0, 1, None, None),
            (1, 0, None, None),
            (1, 1, "Ann", None),
            (2, 0, "Bob", None),
            (2, 1, None, None),
        ],
        key=repr,
    )


def test_lexicon_from_table(spark):
    table = spark.createDataFrame([tuple(cue) for cue in LEXICON], "kind string, lang string, pattern string")
    assert sorted(cues.lexicon_from(table)) == sorted(LEXICON)
    with pytest.raises(ValueError):
        cues.lexicon_from(table, limit=2)


def test_open_items(spark, rows):
    raised = spark.createDataFrame(
        [("a", at("10:00:00")), ("b", at("10:00:00")), ("c", at("10:00:00"))], "item_id string, opened_at timestamp"
    )
    done = spark.createDataFrame(
        [("a", at("09:00:00")), ("a", at("11:00:00")), ("b", at("09:00:00"))], "item_id string, done_at timestamp"
    )
    assert rows(items.open_items(raised, done), "item_id") == [("b",), ("c",)]


def test_search_orders_ties_by_key(make_turns, rows):
    turns = make_turns((2, 0, "a", "red x"), (1, 1, "a", "Red y"), (1, 0, "a", "blue z"), (3, 0, "a", "red red"))
    found = search.search_turns(turns, "RED", 3).collect()
    assert [(r.meeting_id, r.turn) for r in found] == [(3, 0), (1, 1), (2, 0)]
    with pytest.raises(ValueError):
        search.search_turns(turns, " ", 3)


def test_compare(spark, rows):
    schema = "meeting_id long, part long, text string"
    old = publishing.with_version(spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, None)], schema), ["meeting_id", "part"])
    new = publishing.with_version(spark.createDataFrame([(1, 0, "a"), (2, 0, "c"), (4, 0, "d")], schema), ["meeting_id", "part"])
    assert rows(publishing.compare_minutes(old, new, ["meeting_id", "part"]), "meeting_id", "change") == [
        (1, "same"),
        (2, "changed"),
        (3, "removed"),
        (4, "added"),
    ]


def test_redact_twice_is_once(make_turns, rows):
    rules = [publishing.Rule("mail", r"[a-z]+@[a-z.]+", "[mail]"), publishing.Rule("digits", "[0-9]+", "#")]
    turns = make_turns((1, 0, "a", "ann@example.org or bob@example.org, room 12"))
    once = publishing.redact(turns, rules)
    assert once.first().text == "[mail] or [mail], room #"
    assert rows(publishing.redact(once, rules)) == rows(once)
    assert rows(publishing.redaction_counts(turns, rules)) == [("digits", 1), ("mail", 2)]


def test_minutes_as_text(make_turns):
    turns = make_turns(
        (1, 0, "ann", "The budget is too small. Bob will check the budget by 2024-06-01."),
        (1, 1, "bob", "We agreed on a larger hall."),
        (2, 0, "ann", "Hello everybody here."),
    )
    text = minutes.render_minutes(minutes.assemble_minutes(turns, LEXICON)).orderBy("meeting_id").first().markdown
    assert "- ann: 1 turns" in text and "## Topics\n\n- turns 0 to 0: " in text
    assert "- action: Bob will check the budget by 2024-06-01 (owner Bob) (due 2024-06-01)" in text
    assert "- decision: We agreed on a larger hall" in text


def test_cues_of_other_languages_are_none(spark):
    sentences = spark.createDataFrame(
        [(1, 0, 0, "It was raining"), (1, 0, 1, "the e-mail was sent"), (1, 0, 2, "please comment on it")],
        "meeting_id long, turn long, pos int, sentence string",
    )
    assert items.cue_items(sentences).count() == 0


def test_pronouns_own_nothing(spark, rows):
    table = spark.createDataFrame(
        [(0, "ann", "I will send it"), (1, "ann", "We will see"), (2, None, "I will go"), (3, "ann", "This is to end"), (4, "ann", "Bob will pay")],
        "turn int, speaker string, sentence string",
    )
    found = rows(items.item_fields(table), "turn", "owner")
    assert found == [(0, "ann"), (1, None), (2, None), (3, None), (4, "Bob")]
    assert rows(items.item_fields(table.drop("speaker")), "turn", "owner")[0] == (0, None)


def test_search_cuts_words_as_turns_do(make_turns, rows):
    turns = make_turns((1, 0, "a", "The e-mail, the budget"), (1, 1, "a", "a mail"), (1, 2, "a", "none"))
    assert rows(search.search_turns(turns, "e-mail", 5), "turn") == [(0,), (1,)]
    with pytest.raises(ValueError):
        search.search_turns(turns, " - 7 ", 5)


def test_summaries_with_a_repeated_key(make_turns, rows):
    turns = make_turns((1, 0, "a", "one two three. four five six."), (1, 0, "b", "seven eight nine"), (2, 0, "a", "other words here"))
    for found in (terms.key_sentences(turns, 5), terms.central_sentences(turns, 5)):
        assert {r.sentence for r in found.collect()} >= {"one two three", "four five six", "other words here"}


def test_word_rules_leave_nothing_between_matches(make_turns, rows):
    rule = publishing.Rule("article", "(?<![^ ])(?:the|die)(?= )", "*")
    turns = make_turns((1, 0, "a", "the die the end, bathe the"))
    once = publishing.redact(turns, [rule])
    assert rows(once, "text") == [("* * * end, bathe the",)]
    assert rows(publishing.redact(once, [rule])) == rows(once)


# ---- turns without a meeting ----


def test_turns_without_a_meeting_are_a_meeting(make_turns, rows):
    """The same figures as if the null meeting had a number."""
    said = ["we agreed on the red plan. the plan is red", "red red plan. we will paint it", "a blue sky. blue is the sky", "the sky will fall"]
    named = make_turns(*[(1 + n // 2, n % 2, "ab"[n % 2], text) for n, text in enumerate(said)])
    nobody = make_turns(*[(None if n < 2 else 2, n % 2, "ab"[n % 2], text) for n, text in enumerate(said)])
    runs = {
        "stats": lambda turns: talk.speaker_stats(turns),
        "terms": lambda turns: terms.key_terms(turns, 3),
        "key": lambda turns: terms.key_sentences(turns, 2),
        "central": lambda turns: terms.central_sentences(turns, 2),
        "minutes": lambda turns: minutes.assemble_minutes(turns).select("meeting_id", "speakers", "key_terms", "summary", F.size("items").alias("n")),
    }
    for name, run in runs.items():
        as_null = [(1 if row[0] is None else row[0], *row[1:]) for row in rows(run(nobody))]
        assert sorted(as_null, key=repr) == rows(run(named)), name


def test_comparing_a_null_key(spark):
    old = spark.createDataFrame([(None, "x"), (1, "y")], "meeting_id long, version string")
    new = spark.createDataFrame([(None, "x"), (2, "y")], "meeting_id long, version string")
    found = {tuple(row) for row in publishing.compare_minutes(old, new, ["meeting_id"]).collect()}
    assert found == {(None, "same"), (1, "removed"), (2, "added")}


def test_counting_a_long_sentence_is_quick(make_turns):
    words = [f"w{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676)}" for n in range(16_000)]
    turns = make_turns((1, 1, "a", " ".join(words + words[:10])))
    begun = time.perf_counter()
    found = terms.sentence_terms(turns).groupBy("n").count().collect()
    assert {row.n: row["count"] for row in found} == {1: 15_990, 2: 10}
    assert time.perf_counter() - begun < 5


def test_a_user_aggregate_merges_states(make_turns, rows):
    said = [(1, n, "ab"[n % 7 == 0], "x" * (n * 37 % 50)) for n in range(300)] + [(None, 1, "a", "xx"), (None, 2, None, "x"), (2, 1, "a", None)]
    longest = hooks.speaker_aggregate(
        "lengths", set, lambda state, texts: state | set(texts.dropna().str.len()), lambda a, b: a | b, len, "int", keys_in_hand=2
    )
    turns = make_turns(*said).repartition(6)
    expected = {}
    for meeting, _, speaker, text in said:
        own = expected.setdefault((meeting, speaker), set())
        own |= {len(text)} if text is not None else set()
    found = rows(talk.speaker_stats(turns, reducer=longest), "meeting_id", "speaker", "lengths")
    assert found == sorted(((*key, len(lengths)) for key, lengths in expected.items()), key=repr)
