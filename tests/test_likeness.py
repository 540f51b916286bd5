"""Degrees of sentences against a count of all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from minutary.operators import likeness


def plain(rows, threshold):
    sentences = []
    for meeting, turn, _, text in rows:
        pieces = [piece.strip() for piece in re.split(r"[.!?]+\s*|\n+", text or "")]
        for pos, piece in enumerate(piece for piece in pieces if piece):
            sentences.append((meeting, turn, pos, frozenset(re.findall(r"[^\W\d_]+", piece.lower()))))
    found = []
    for one in sentences:
        degree = 0
        for other in sentences:
            if other is not one and other[0] == one[0] and one[3] and other[3]:
                degree += len(one[3] & other[3]) / len(one[3] | other[3]) >= threshold
        found.append((*one[:3], degree))
    return sorted(found, key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"] + ["the"] * 20
    rows = []
    for turn in range(90):
        text = ". ".join(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4, 8, 15]))) for _ in range(3))
        rows.append((1 if turn % 3 else rng.choice([2, None]), turn, "a", text))
    rows += [(1, 200 + n, "b", "the ax by") for n in range(30)] + [(4, 1, "a", None), (4, 2, "a", "12. ?! 7"), (5, 1, "a", "alone")]
    return rows


@pytest.mark.parametrize("threshold, chunk_rows", [(0.1, 256), (0.1, 5), (0.5, 3), (1.0, 4)])
def test_degrees_equal_all_pairs(make_turns, rows, threshold, chunk_rows):
    talk = rows_of(round(threshold * 10))
    found = likeness.sentence_degrees(make_turns(*talk), threshold, chunk_rows)
    assert rows(found, "meeting_id", "turn", "pos", "degree") == plain(talk, threshold)


def test_degrees_of_nothing(make_turns):
    assert likeness.sentence_degrees(make_turns()).collect() == []


def test_best_linked_first(make_turns):
    talk = [(1, 1, "a", "red green. blue red"), (1, 2, "b", "green blue red"), (1, 3, "b", "pink")]
    best = likeness.linked_sentences(make_turns(*talk), 2, 0.5).orderBy("place").collect()
    assert [(row.turn, row.pos, row.degree, row.sentence) for row in best] == [(2, 0, 2, "green blue red"), (1, 0, 1, "red green")]


def test_rare_words_take_no_matrix(monkeypatch):
    """Rows of several words, few of each, are compared at once, as one word after the other with matrices gives it."""
    rng, rarity, rows, cuts = random.Random(7), [1 + n % 5 for n in range(30)], [], []
    for group in range(40):
        key, within = rng.randrange(30), group % 2 == 0
        for chunk in sorted(rng.randrange(1 if within else 2) for _ in range(rng.randrange(1, 12))):
            words = sorted({key, *(rng.randrange(30) for _ in range(rng.randrange(8)))}, key=lambda word: (rarity[word], word))
            rows.append({
                "within": within, "chunk": chunk, "set_id": bytes([len(rows) % 256]), "weight": rng.randrange(1, 4),
                "rarities": [rarity[word] for word in words], "words": words, "rarity": rarity[key], "word": key,
            })
        cuts.append(len(rows))
    table = pa.Table.from_pylist(rows)
    wanted = [degree for start, end in zip([0, *cuts], cuts) for degree in likeness._degrees(table.slice(start, end - start), 0.3)]
    monkeypatch.setattr(likeness, "_overlaps", None)
    found = [degree for part in likeness._all_degrees(table, np.array(cuts), 0.3) for degree in part.column("degree").to_pylist()]
    assert found == wanted
    assert any(found)
