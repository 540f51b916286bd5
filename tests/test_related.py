"""Nearest meetings against brute force, and how much is skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from minutary.operators import related

VECTORS = "vec_id long, embedding array<double>, block string, cell string"


def plain(rows, k, asked=lambda key: True):
    known = {}
    for key, vector in rows:
        if key is not None and vector and None not in vector and np.isfinite(vector).all() and any(vector):
            known[key] = min(vector, known.get(key, vector))
    units = {key: np.array(vector) / np.abs(vector).max() for key, vector in known.items()}
    units = {key: unit / np.linalg.norm(unit) for key, unit in units.items()}
    found = []
    for key, own in units.items():
        if not asked(key):
            continue
        best = {other: round(float(own @ theirs), 6) + 0.0 for other, theirs in units.items() if other != key}
        ranked = sorted(best.items(), key=lambda pair: (-pair[1], pair[0]))[:k]
        found += [(key, rank, other, cosine) for rank, (other, cosine) in enumerate(ranked, 1)]
    return sorted(found)


def clusters(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(key, list(map(float, centres[rng.integers(12)] + spread * rng.normal(size=dims)))) for key in range(n)]


@pytest.fixture
def make_vectors(spark):
    return lambda rows: spark.createDataFrame([(*row, "x", "y") for row in rows], VECTORS)


def taken(frame):
    return sorted((row.vec_id, row["rank"], row.related_id, row.cosine) for row in frame.collect())


@pytest.mark.parametrize("block_rows", [7, 40, 8192])
def test_related_equals_brute_force(make_vectors, block_rows):
    rows = clusters(block_rows, 150, 6, 0.2)
    rows += [(500 + n, rows[3][1]) for n in range(30)] + [(3, rows[9][1]), (4, rows[4][1])]
    odd = [(600, None), (601, []), (602, [None] * 6), (603, [0.0] * 6), (604, [float("nan")] * 6), (605, [1.0] * 7), (None, rows[0][1])]
    odd += [(606, [1e300] * 6), (607, [1e-300] * 6)]
    found = related.related_meetings(make_vectors(rows + odd), 5, pivots=8, block_rows=block_rows)
    assert taken(found) == plain([row for row in rows + odd if row[0] != 605], 5)


def test_related_only_for_those_that_ask(make_vectors):
    rows = clusters(2, 120, 5, 0.5)
    found = related.related_meetings(make_vectors(rows), 3, F.col("vec_id") % 10 == 0, pivots=4, block_rows=16)
    assert taken(found) == plain(rows, 3, lambda key: key % 10 == 0)


def test_related_with_few_others(make_vectors):
    assert related.related_meetings(make_vectors([]), 3).collect() == []
    assert related.related_meetings(make_vectors([(1, None)]), 3).collect() == []
    assert related.related_meetings(make_vectors([(1, [1.0, 0.0])]), 3).collect() == []
    pair = [(1, [1.0, 0.0]), (2, [0.0, 2.0])]
    assert taken(related.related_meetings(make_vectors(pair), 3)) == plain(pair, 3) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]


def test_far_clusters_are_skipped(make_vectors):
    placed = related.place(make_vectors(clusters(4, 600, 8, 0.02)), 3, pivots=16, block_rows=20)
    blocks = placed.select("block").distinct().count()
    groups = placed.select("asking").distinct().count()
    assert related.open_pairs(placed).count() < 0.25 * groups * (blocks - 1)


@pytest.mark.parametrize("least", [-1.0, 0.0, 0.3])
def test_only_entries_that_can_be_best_are_rounded(monkeypatch, least):
    rng = np.random.default_rng(5)
    cosines, ids = np.round(rng.uniform(-1, 1, size=(20, 4000)), 2), rng.permutation(4000)
    own, lowest = ids[:20], np.full(20, least)
    lowest[:15] = 0.99
    rounded, plain_rounded = [], related._rounded
    monkeypatch.setattr(related, "_rounded", lambda values: rounded.append(values.size) or plain_rounded(values))
    row, column = related.k_best(ids, plain_rounded(cosines), own, 4, lowest)
    found = related._better(ids, cosines, own, 4, lowest)
    assert [list(each) for each in found] == [list(own[row]), list(ids[column]), list(cosines[row, column])]
    related._better(ids, cosines, own, 4, np.full(20, 0.99))
    assert rounded[-1] < 0.02 * cosines.size
