"""Cues of large tables, and items closed in later meetings."""

import random
import re

import pytest

from minutary.functions import cues
from minutary.operators import items, shaping
from minutary.session import settle

CUES = "kind string, lang string, pattern string"
ITEMS = "item_id string, meeting_id long, turn long, pos int, kind string, sentence string, note string"


def test_a_table_of_cues_finds_what_the_patterns_find(spark, make_turns, rows):
    turns = make_turns(
        (1, 0, "a", "We will follow up. Who needs to do it? It need to be done! willing"), (1, 1, "b", "action-item. To do: x"),
        (2, 0, "a", "agreed, AGREED; agreed"), (None, 3, "a", "who will"), (3, 0, "a", None), (3, 1, "a", "what a needles to"),
    )
    table = spark.createDataFrame([tuple(cue) for cue in cues.CUES], CUES)
    sentences = shaping.sentences(turns, keep=["meeting_id", "turn", "speaker"])
    names = ["item_id", "meeting_id", "turn", "pos", "kind", "sentence", "speaker"]
    assert rows(items.cue_items(sentences, table), *names) == rows(items.cue_items(sentences), *names)


def test_fifty_thousand_cues(spark, make_turns, rows):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    listed = [cues.Cue(rng.choice(["action", "done"]), rng.choice(["en", "de"]), " ".join(word() for _ in range(rng.choice([2, 2, 3])))) for _ in range(50_000)]
    text = ". ".join(" ".join(word() for _ in range(40)) for _ in range(40))
    turns = make_turns(*[(n % 3, n, "a", text[n * 50 :]) for n in range(20)])
    sentences = shaping.sentences(turns)
    found = rows(items.cue_items(sentences, spark.createDataFrame([tuple(cue) for cue in listed], CUES)), "meeting_id", "turn", "pos", "kind")
    phrases = {kind: {cue.pattern for cue in listed if cue.kind == kind and cue.lang == "en"} for kind in ("action", "done")}
    expected = []
    for row in sentences.collect():
        words = row.sentence.split(" ")
        runs = {" ".join(words[at : at + size]) for size in (2, 3) for at in range(len(words) - size + 1)}
        expected += [(row.meeting_id, row.turn, row.pos, kind) for kind in phrases if runs & phrases[kind]]
    assert found == sorted(expected, key=repr) and len(expected) > 100


def test_optional_letters_and_phrases_without_letters(spark, rows):
    table = spark.createDataFrame([("a", "en", "needs? to|colou?rs?"), ("b", "en", "1 2|?"), ("c", "en", None)], CUES)
    found = [row.phrase for row in cues.phrases(table).collect()]
    assert sorted(found) == ["color", "colors", "colour", "colours", "need to", "needs to"]


# ---- closing items ----


def test_an_action_is_closed_in_a_later_meeting(spark, rows):
    told = [
        ("a1", 1, 0, 0, "action", "Ann will write the budget report"),
        ("a2", 1, 1, 0, "action", "Bob will paint the red door"),
        ("a3", 2, 0, 0, "action", "Ann will write the budget report"),
        ("d0", 1, 0, 0, "done", "Ann will write the budget report"),  # said in the same sentence as a1
        ("d1", 2, 5, 0, "done", "the red door is painted, Bob has done it"),
        ("d2", 3, 0, 0, "done", "done: Ann did write the budget report"),
        ("d3", 3, 1, 0, "done", "we are done"),
        ("a4", 4, 0, 0, "action", "Cid will buy chairs"),
        ("d4", 3, 9, 0, "done", "Cid did buy chairs"),  # before it was asked for
        ("a5", None, 0, 0, "action", "nobody will write the budget report"),
        ("a6", 1, 2, 0, "action", "?!"),
    ]
    frame = spark.createDataFrame([(*row, "x") for row in told], ITEMS)
    found = rows(items.closed_items(frame), "item_id", "closed_by")
    assert found == sorted([("a1", None), ("a2", "d1"), ("a3", "d2"), ("a4", None), ("a5", None), ("a6", None)], key=repr)


def plain_closed(rows, least=0.5):
    import math

    sets = {row[0]: frozenset(re.findall(r"[^\W\d_]+", row[5].lower())) for row in rows}
    wordings = set(sets.values())
    weight = {w: math.log((len(wordings) + 1) / sum(w in each for each in wordings)) for each in wordings for w in each}
    count = {w: sum(w in each for each in wordings) for w in weight}
    closed = {}
    for report in rows:
        if report[4] != "done":
            continue
        best = None
        for action in rows:
            if action[4] != "action" or (*action[1:4], 1) > (*report[1:4], 0) or not sets[action[0]]:
                continue
            own = sets[action[0]]
            if not set(sorted(own, key=lambda w: (count[w], w))[:3]) & sets[report[0]]:
                continue
            score = round(sum(round(weight[w] * 1e6) for w in own & sets[report[0]]) / 1e6 / sum(weight[w] for w in own), 4)
            rank = (-score, [-x for x in action[1:4]], action[0])
            if score >= least and (best is None or rank < best[0]):
                best = (rank, action[0])
        if best:
            closed[best[1]] = min(closed.get(best[1], ((9**9,), "")), ((*report[1:4], report[0]), report[0]))
    return sorted(((row[0], closed[row[0]][1] if row[0] in closed else None) for row in rows if row[4] == "action"), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_closing_equals_all_pairs(spark, rows, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    told = []
    for n in range(160):
        sentence = "ab common " + " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4])))
        told.append((f"i{n:03}", rng.randrange(4), n // 2, n % 2, rng.choice(["action", "done"]), sentence))
    frame = spark.createDataFrame([(*row, "x") for row in told], ITEMS)
    assert rows(items.closed_items(frame), "item_id", "closed_by") == plain_closed(told)


def test_closing_writes_no_pairs_of_wordings(spark, rows, monkeypatch):
    """A tenth of the actions and reports have one word of three in common, which makes 200 x 20 pairs of score 0.1 and more."""
    own = lambda n: "own" + "abcdefghijklmnopqrst"[n // 20] + "abcdefghijklmnopqrst"[n % 20]
    told = [(f"a{n:03}", 1, n, 0, "action", f"topic{'abcdefghij'[n % 10]} {own(n)} more{own(n)}") for n in range(200)]
    told += [(f"d{n:03}", 2, n, 0, "done", f"topic{'abcdefghij'[n % 10]} {own(n)} told{own(n)}") for n in range(200)]
    written = []

    def counted(df, path=None):
        kept = settle(df, path)
        written.append(kept.count())
        return kept

    monkeypatch.setattr(items, "settle", counted)
    found = rows(items.closed_items(spark.createDataFrame([(*row, "x") for row in told], ITEMS), least=0.1), "item_id", "closed_by")
    assert found == [(f"a{n:03}", f"d{n:03}") for n in range(200)]
    assert max(written) <= 3 * 200


def closed_by_all_pairs(rows, least):
    """The rule of `closed_items`, with every action tried for every report."""
    import math

    sets = {row[0]: frozenset(re.findall(r"[^\W\d_]+", row[5].lower())) for row in rows}
    wordings = set(sets.values())
    weight = {w: math.log((len(wordings) + 1) / sum(w in each for each in wordings)) for each in wordings for w in each}
    whole = {name: sum(weight[w] for w in own) for name, own in sets.items()}
    share = lambda action, report: round(sum(round(weight[w] * 1e6) for w in sets[action] & sets[report]) / 1e6 / whole[action], 4)
    closed = {}
    for report in sorted((row for row in rows if row[4] == "done"), key=lambda row: (*row[1:4], row[0])):
        earlier = [row for row in rows if row[4] == "action" and row[1:4] < report[1:4] and sets[row[0]]]
        scored = [(share(row[0], report[0]), *row[1:4], row[0]) for row in earlier if share(row[0], report[0]) >= least]
        if scored:
            best = min(scored, key=lambda each: (*(-number for number in each[:4]), each[4]))
            closed.setdefault(best[4], report[0])
    return sorted(((row[0], closed.get(row[0])) for row in rows if row[4] == "action"), key=repr)


def test_a_report_without_the_rarest_words_of_an_action_closes_it(spark, rows):
    told = [("a0", 1, 0, 0, "action", "Kim prints rare orchid labels for the garden show in spring")]
    told += [(f"a{n}", 1, n, 0, "action", f"own{'abcdefghijklmnopqrstuvwxyz'[n]}") for n in range(1, 25)]
    told += [("d0", 2, 0, 0, "done", "labels for the garden show in spring")]
    frame = spark.createDataFrame([(*row, "x") for row in told], ITEMS)
    found = rows(items.closed_items(frame), "item_id", "closed_by")
    assert ("a0", "d0") in found and found == closed_by_all_pairs(told, 0.5)


@pytest.mark.parametrize("listed", [items.LISTED_WORDS, 2])
def test_closing_looks_at_every_word(spark, rows, monkeypatch, listed):
    """Actions of many words of their own; few reports have one of these. The lists of words travel, or are fetched."""
    monkeypatch.setattr(items, "LISTED_WORDS", listed)
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    told = []
    for n in range(160):
        own = [f"own{letters[n % 26]}{letters[n // 26]}{letters[at]}" for at in range(rng.choice([0, 3, 5, 9]))]
        kind = rng.choice(["action", "done"])
        sentence = " ".join(["common", *rng.sample(words, rng.choice([2, 4, 8])), *(own if kind == "action" else own[:1])])
        told.append((f"i{n:03}", rng.randrange(4), n // 2, n % 2, kind, sentence))
    frame = spark.createDataFrame([(*row, "x") for row in told], ITEMS)
    expected = closed_by_all_pairs(told, 0.1)
    assert rows(items.closed_items(frame, least=0.1), "item_id", "closed_by") == expected
    assert sum(closed is not None for _, closed in expected) >= 20
