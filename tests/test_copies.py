"""Near copies and groups against brute force."""

import random
import re

import pytest

from minutary.operators import copies, groups

DOCS = "doc_id long, text string, id string, runs string, band int"


def runs_of(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if len(words) < 5:
        return frozenset([" ".join(words)] if words else [])
    return frozenset(" ".join(words[at : at + 5]) for at in range(len(words) - 4))


def plain_groups(links):
    root = {node: node for link in links for node in link}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {node: find(node) for node in root}


def plain_copies(rows, threshold=0.8):
    known = [(doc, runs_of(text)) for doc, text in rows if doc is not None]
    links = [(doc, doc) for doc, _ in known]
    for a, own in known:
        for b, theirs in known:
            if own == theirs or len(own & theirs) >= threshold * len(own | theirs):
                links.append((a, b))
    return plain_groups(links)


def prose(rng, size):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(size))


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = "".join(rng.choice("klmnop") for _ in range(5))
    return " ".join(words)


@pytest.fixture
def make_docs(spark):
    return lambda rows: spark.createDataFrame([(*row, "x", "y", 3) for row in rows], DOCS)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(n, n + 1) for n in range(200, 280)] + [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    links += [(500, 500 + n) for n in range(60)] + [(rng.choice(range(700, 760)), 700) for _ in range(40)]
    rng.shuffle(links)
    frame = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long")
    assert {row.node: row.group_id for row in groups.groups(frame).collect()} == plain_groups(links)
    assert groups.groups(frame.limit(0)).collect() == []


def test_copies_equal_brute_force(make_docs):
    rng = random.Random(7)
    rows = [(n, prose(rng, rng.choice([1, 3, 5, 6, 40, 300]))) for n in range(40)]
    base = prose(rng, 400)
    # A large group, a chain of edits, and texts that share a third only.
    rows += [(100 + n, edited(rng, base, rng.choice([0, 2, 4]))) for n in range(60)]
    chain = prose(rng, 300)
    for n in range(12):
        rows.append((200 + n, chain))
        chain = edited(rng, chain, 3)
    rows += [(300 + n, " ".join(base.split(" ")[:130]) + " " + prose(rng, 270)) for n in range(25)]
    rows += [(400, None), (401, ""), (402, "?! 12"), (403, "One two"), (404, "one, TWO!"), (None, base), (5, base), (405, rows[9][1])]
    rows += [(406, prose(rng, 20_000))]
    rng.shuffle(rows)
    found = {row.doc_id: row.group_id for row in copies.near_copies(make_docs(rows)).collect()}
    assert found == plain_copies(rows)


def test_copies_of_nothing(make_docs):
    assert copies.near_copies(make_docs([])).collect() == []
    assert [tuple(row) for row in copies.near_copies(make_docs([(None, "a"), (3, None)])).collect()] == [(3, 3, 1)]


def test_recall_at_the_threshold(make_docs):
    """Pairs whose similarity is 0.8 to 0.83 alone, each pair with words of its own."""
    rng, rows = random.Random(3), []
    while len(rows) < 600:
        text = prose(rng, 200)
        other = edited(rng, text, 4)
        own, theirs = runs_of(text), runs_of(other)
        if 0.8 <= len(own & theirs) / len(own | theirs) <= 0.83:
            rows += [(len(rows), text), (len(rows) + 1, other)]
    found = {row.doc_id: row.group_id for row in copies.near_copies(make_docs(rows)).collect()}
    assert sum(found[n] == found[n + 1] for n in range(0, 600, 2)) >= 0.95 * 300
    assert all(found[n] == n for n in range(0, 600, 2))


def test_a_large_group_is_not_paired_with_itself(make_docs):
    rng = random.Random(9)
    base = prose(rng, 300)
    rows = [(n, edited(rng, base, 2)) for n in range(300)]
    _, runs = copies._texts(make_docs(rows))
    filled = runs.selectExpr("id", "runs", "size(runs) AS size")
    signed = filled.mapInArrow(copies._signatures, "id long, size int, bands array<long>")
    members = signed.selectExpr("id", "size", "posexplode(bands) AS (band, value)").selectExpr("*", "true AS alone")
    first, compared = copies._with_distance(copies._hub_pairs(members, 1), filled, "d1")
    assert compared.count() < 300 * copies.BANDS * 3


def test_only_texts_that_share_a_bucket_are_compared(make_docs, monkeypatch):
    rng, sets = random.Random(11), []
    rows = [(n, prose(rng, 60)) for n in range(50)]
    rows += [(50, edited(rng, rows[0][1], 1))]
    plain = copies._similar

    def counted(pairs, runs):
        sets.append(runs.count())
        return plain(pairs, runs)

    monkeypatch.setattr(copies, "_similar", counted)
    found = {row.doc_id: row.group_id for row in copies.near_copies(make_docs(rows)).collect()}
    assert found == {**{n: n for n in range(50)}, 50: 0}
    assert max(sets) <= 2
