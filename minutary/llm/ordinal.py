"""Quality by ordinal regression: graded ratings, one set of weights, ordered thresholds.

The chance of a grade of at most k is a logistic of threshold k minus the text's value, so all
thresholds share the weights (McCullagh 1980). A text's features are which hashed words
occur in it, and shares of its words by make-up (letters, capitals, digits, symbols, repeats).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from minutary.llm import batches, hashing

BUCKETS = 1 << 18
SHAPES = 32
# Labelled documents to learn from, those with the smallest hash of the id. A bound for the
# driver, which fits the weights; the features of these documents are all that it gets.
SAMPLE_ROWS = 20_000
# A word in fewer documents of the sample has no weight.
LEAST_DOCS = 10
STEPS = 200
RATE = 0.05
PENALTY = 1e-4
DOCS_IN_HAND = 128


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, 3, dtype=np.uint8)  # 3: symbol
    kinds[ord("A") : ord("Z") + 1] = 0
    kinds[ord("a") : ord("z") + 1] = 1
    kinds[128:] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    return kinds


_KINDS = _byte_kinds()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket, shares): each text's different word buckets, and its SHAPES + 1 shares."""
    words = [text.split() for text in texts]
    joined, starts, ends, owner = hashing.shingle_spans(words, 1)
    shares = np.zeros((len(texts), SHAPES + 1))
    if not len(owner):
        return owner, owner, shares
    hashes = hashing.xxh64_spans(joined.lower(), starts, ends, 7)
    pairs = np.unique(owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))
    kinds = _KINDS[np.frombuffer(joined, dtype=np.uint8)]
    kinds = np.where(np.frombuffer(joined, dtype=np.uint8) == 32, 4, kinds)
    upper, lower, digit, symbol = (np.add.reduceat(kinds == kind, starts, dtype=np.int64) for kind in range(4))
    shape = (upper > 0) + 2 * (lower > 0) + 4 * (digit > 0) + 8 * (symbol == 1) + 16 * (symbol > 1)
    total = np.bincount(owner, minlength=len(texts))
    np.add.at(shares, (owner, shape), 1)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) + 1
    np.add.at(shares, (owner[again], SHAPES), 1)
    return pairs // BUCKETS, pairs % BUCKETS, shares / np.maximum(total, 1)[:, None]


class GradeModel:
    """Weights of buckets and shares, and thresholds between grades in rising order."""

    def __init__(self, weights: np.ndarray, share_weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.share_weights, self.thresholds = weights, share_weights, thresholds

    def values(self, texts: list[bytes]) -> np.ndarray:
        owner, bucket, shares = features(texts)
        return np.bincount(owner, self.weights[bucket], minlength=len(texts)) + shares @ self.share_weights

    def tails(self, values: np.ndarray) -> np.ndarray:
        """(texts, grades - 1): the chance of a grade above each threshold."""
        return _logistic(values[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(owner: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray, width: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full gradients and Adam; features as (row, column, value)."""
    rows = len(grades)
    weights = np.zeros(width)
    # The first threshold and the logarithms of the steps between them keep the order.
    free = np.zeros(max(levels - 1, 0))
    moments = [np.zeros(width + len(free)), np.zeros(width + len(free))]
    above, below = grades < levels - 1, grades > 0
    for step in range(1, STEPS + 1):
        thresholds = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(owner, weights[column] * value, minlength=rows)
        high = np.ones(rows)
        low = np.zeros(rows)
        high[above] = _logistic(thresholds[grades[above]] - score[above])
        low[below] = _logistic(thresholds[grades[below] - 1] - score[below])
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = (slope_high - slope_low) / rows
        gradient = np.bincount(column, by_score[owner] * value, minlength=width) + PENALTY * weights
        by_threshold = np.bincount(grades[below] - 1, slope_low[below], minlength=levels - 1)[: levels - 1] if levels > 1 else np.zeros(0)
        by_threshold = by_threshold - np.bincount(grades[above], slope_high[above], minlength=levels - 1)[: levels - 1]
        by_threshold = np.cumsum(by_threshold[::-1])[::-1] / rows  # a step moves all thresholds after it
        by_free = by_threshold * np.concatenate([np.ones(len(free[:1])), np.exp(free[1:])])
        whole = np.concatenate([gradient, by_free])
        moments[0] = 0.9 * moments[0] + 0.1 * whole
        moments[1] = 0.999 * moments[1] + 0.001 * whole**2
        change = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        weights -= change[:width]
        free -= change[width:]
    return weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def learn(docs: DataFrame, grades: DataFrame, levels: int, sample_rows: int = SAMPLE_ROWS) -> GradeModel:
    """From `docs` (doc_id, text) with a grade from 0 to levels - 1 in `grades` (doc_id, grade).

    Rows without an id or a grade are left out; of several grades of one document the lowest counts.
    Without any rated document, all weights and thresholds are zero.
    """
    rated = grades.filter("doc_id IS NOT NULL AND grade BETWEEN 0 AND " + str(levels - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.select(F.col("doc_id").alias("_id"), F.col("grade").cast("int").alias("_grade")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # At most `sample_rows` ids and grades.
    picked = docs.select("doc_id", batches.text_bytes().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def step(source):
        for batch in batches.pieces(source, DOCS_IN_HAND, "text"):
            owner, bucket, shares = features(batch.column("text").to_pylist())
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            buckets = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield {"grade": batch.column("_grade"), "buckets": buckets, "shares": [row.astype("<f8").tobytes() for row in shares]}

    found = batches.map_arrow(picked, step, "grade int, buckets binary, shares binary").toArrow()
    y = found.column("grade").to_numpy()
    buckets = [np.frombuffer(raw, dtype="<u4") for raw in found.column("buckets").to_pylist()]
    shares = np.array([np.frombuffer(raw, dtype="<f8") for raw in found.column("shares").to_pylist()]).reshape(len(y), SHAPES + 1)
    if not len(y):
        return GradeModel(np.zeros(BUCKETS), np.zeros(SHAPES + 1), np.zeros(levels - 1))
    owner = np.repeat(np.arange(len(y)), [len(each) for each in buckets])
    bucket = np.concatenate(buckets).astype(np.int64)
    seen = np.bincount(bucket, minlength=BUCKETS)
    kept = np.flatnonzero(seen >= LEAST_DOCS)
    at = np.full(BUCKETS, -1)
    at[kept] = np.arange(len(kept))
    own = at[bucket] >= 0
    place, share = np.nonzero(shares)
    rows = np.concatenate([owner[own], place])
    columns = np.concatenate([at[bucket[own]], len(kept) + share])
    values = np.concatenate([np.ones(int(own.sum())), shares[place, share]])
    weights, thresholds = fit(rows, columns, values, y.astype(np.int64), len(kept) + SHAPES + 1, levels)
    full = np.zeros(BUCKETS)
    full[kept] = weights[: len(kept)]
    return GradeModel(full, weights[len(kept) :], thresholds)


def grade_texts(docs: DataFrame, model: GradeModel) -> DataFrame:
    """(rest, value, expected_grade, tails) for every row of `docs` (text, anything else).

    `tails` holds the chance of at least grade 1, 2 and so on, falling; `rest` the other columns as
    a struct. Null, empty and wordless texts have value 0. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [F.col(name) for name in docs.columns if name != "text"]
    packed = docs.select(F.struct(*others).alias("rest"), batches.text_bytes().alias("text"))

    def step(source):
        model = shared.value
        for batch in batches.pieces(source, DOCS_IN_HAND, "text"):
            values = model.values(batch.column("text").to_pylist())
            tails = model.tails(values)
            yield {"rest": batch.column("rest"), "value": values, "expected_grade": tails.sum(axis=1), "tails": tails.tolist()}

    return batches.with_fields(packed, ["rest"], step, "value double, expected_grade double, tails array<double>")


def grade_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 toxic, 1 poor, 2 good; null if the ratings do not say."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)
