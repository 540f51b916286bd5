"""Language of texts and of spans in them.

Letters in a row are a word. The script of its first letter, by ranges of code points, narrows the
languages to those that write in it; runs of three letters score them. A Viterbi pass over the words of a
document, with a penalty for each switch of language, cuts the text into spans of one
language each; the language with most letters names the document.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from minutary.llm import batches

UNKNOWN = "und"
BUCKETS = 1 << 15
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
# A language writes in a script if this share of its letters is in it.
SCRIPT_SHARE = 0.01
DOCS_IN_HAND = 256
CODE_POINTS = 0x110000

# First code points of Unicode ranges, and their scripts (fixed values).
SCRIPTS = ["common", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han"]
RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x07C0, "common"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "common"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "common"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "common"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"), (0x2C60, "latin"),
    (0x2C80, "common"), (0x2DE0, "cyrillic"), (0x2E00, "common"), (0x2E80, "han"), (0x3040, "kana"),
    (0x3100, "common"), (0x3130, "hangul"), (0x3190, "common"), (0x31F0, "kana"), (0x3200, "common"),
    (0x3400, "han"), (0xA000, "common"), (0xA640, "cyrillic"), (0xA6A0, "common"), (0xA720, "latin"),
    (0xA800, "common"), (0xAC00, "hangul"), (0xD800, "common"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "common"), (0xFE70, "arabic"),
    (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "common"), (0x20000, "han"), (0x32000, "common"),
]


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or 0 for what is no letter, and the script."""
    lower = np.zeros(CODE_POINTS, dtype=np.uint32)
    for code in range(0x32000):  # no letters are assigned above
        letter = chr(code)
        if letter.isalpha():
            small = letter.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    script = np.zeros(CODE_POINTS, dtype=np.uint8)
    for (first, name), end in zip(RANGES, [*[start for start, _ in RANGES[1:]], CODE_POINTS]):
        script[first:end] = SCRIPTS.index(name)
    return lower, script


def _letters(texts: list[str], lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with a gap after each, their lower-case letters or 0, and
    where each text begins (and the last one ends)."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    begins = np.cumsum([0, *[len(text) + 1 for text in texts]])
    return codes, lower[codes], begins


def _buckets(letters: np.ndarray) -> np.ndarray:
    """A bucket for every position: the letter with the ones before and after it (0: none)."""
    wide = letters.astype(np.uint64)
    before, after = np.zeros_like(wide), np.zeros_like(wide)
    before[1:], after[:-1] = wide[:-1], wide[1:]
    mixed = (before * np.uint64(0x9E3779B1) + wide) * np.uint64(0x85EBCA77) + after
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(49)).astype(np.int64)


def letter_counts(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, place, n): counts of buckets, and of letters by script at BUCKETS + script.

    Each task counts in arrays first; what is shuffled is languages x buckets per task at most.
    """

    def step(source):
        lower, script = letter_tables()
        width = BUCKETS + len(SCRIPTS)
        totals: dict[str, np.ndarray] = {}
        for batch in batches.pieces(source, text="text"):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for name in dict.fromkeys(langs):
                codes, letters, _ = _letters([text for text, own in zip(texts, langs) if own == name], lower)
                is_letter = letters > 0
                places = np.concatenate([_buckets(letters)[is_letter], BUCKETS + script[codes[is_letter]].astype(np.int64)])
                totals[name] = totals.get(name, 0) + np.bincount(places, minlength=width)
        for name, counts in totals.items():
            places = np.flatnonzero(counts)
            yield {"lang": [name] * len(places), "place": places.astype(np.int32), "n": counts[places]}

    narrow = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).alias("lang"), "text")
    return batches.map_arrow(narrow, step, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Languages, log weights (bucket, language), and which languages write in a script."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
        totals = grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS
        self.langs = langs
        self.weights = np.ascontiguousarray(np.log((grams + SMOOTHING) / totals).T.astype(np.float32))
        shares = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.writes = (shares >= SCRIPT_SHARE).T
        self.common = int(scripts.sum(axis=1).argmax()) if langs else 0
        # A script that no language writes in tells nothing about any.
        self.writes |= ~self.writes.any(axis=1, keepdims=True)


def learn(docs: DataFrame, lang: str = "lang") -> LanguageModel:
    """From all rows of `docs` with a language and a text. The driver gets the model alone:
    one count per language and bucket or script, whatever the number of rows."""
    found = letter_counts(docs, lang).toArrow()
    names = np.array(found.column("lang").to_pylist(), dtype=object)
    langs = sorted(set(names.tolist()))
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    at = {name: row for row, name in enumerate(langs)}
    counts[[at[name] for name in names], found.column("place").to_numpy()] = found.column("n").to_numpy()
    return LanguageModel(langs, counts)


def word_scores(codes: np.ndarray, letters: np.ndarray, script: np.ndarray, model: LanguageModel):
    """(starts, ends, scores): the words of a text and their log scores by language."""
    padded = np.concatenate([[0], letters > 0, [0]]).astype(np.int8)
    edges = np.diff(padded)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return starts, ends, np.zeros((0, len(model.langs)), dtype=np.float32)
    inside = np.flatnonzero(letters)
    by_letter = model.weights[_buckets(letters)[inside]]
    scores = np.add.reduceat(by_letter, np.searchsorted(inside, starts), axis=0)
    barred = ~model.writes[script[codes[starts]]]
    scores[barred] = scores.min() - 100.0
    return starts, ends, scores


def best_spans(scores: np.ndarray, firsts: np.ndarray, counts: np.ndarray, penalty: float) -> list[list[tuple[int, int, int]]]:
    """For each document, (first word, last word, language) of the best path's spans.

    Documents advance together, one word each at a time, longest first. For every word and
    language the start of the span that ends there is kept, so spans are read off backwards.
    """
    order = np.argsort(-counts, kind="stable")
    firsts, counts = firsts[order], counts[order]
    languages = scores.shape[1]
    since = np.zeros((len(scores), languages), dtype=np.int32)
    best = np.zeros(len(scores), dtype=np.int16)
    active = int((counts > 0).sum())
    value = scores[firsts[:active]].astype(np.float64)
    begun = np.zeros((active, languages), dtype=np.int32)
    final = np.zeros((len(counts), languages))
    live = np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), side="right")
    for word, now in enumerate(live):
        if word:
            final[now:active] = value[now:]
            value, begun = value[:now], begun[:now]
            jump = value.max(axis=1, keepdims=True) - penalty
            switched = jump > value
            value = np.where(switched, jump, value) + scores[firsts[:now] + word]
            begun = np.where(switched, word, begun)
        active = now
        since[firsts[:now] + word] = begun
        best[firsts[:now] + word] = value.argmax(axis=1)
    final[:active] = value
    found: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    for at, (first, count) in enumerate(zip(firsts.tolist(), counts.tolist())):
        last, language = count - 1, int(final[at].argmax())
        while last >= 0:
            start = int(since[first + last, language])
            found[order[at]].append((start, last, language))
            last = start - 1
            language = int(best[first + last]) if start else 0
    return [spans[::-1] for spans in found]


def identify(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(rest, text, lang_pred, score, spans) for every row of `docs` (text, anything else).

    `rest` holds the other columns as a struct and is not looked at. `spans` are (start, length,
    lang) by code points, in order. `score` is the share of the text's letters in spans of
    `lang_pred`. Ties go to the language first in the alphabet. Null or letterless texts, and all texts if no language has been learned,
    give `und`, score 0 and no spans. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [F.col(name) for name in docs.columns if name != "text"]
    packed = docs.select(F.struct(*others).alias("rest"), "text")

    def step(source):
        lower, script = letter_tables()
        model = shared.value
        for batch in batches.pieces(source, DOCS_IN_HAND, "text"):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            codes, letters, begins = _letters(texts, lower)
            if model.langs:
                starts, ends, scores = word_scores(codes, letters, script, model)
                firsts = np.searchsorted(starts, begins[:-1])
                counts = np.searchsorted(starts, begins[1:]) - firsts
                spans = best_spans(scores, firsts, counts, penalty)
            else:
                spans = [[] for _ in texts]
            labels, shares, placed = [], [], []
            for at, own in enumerate(spans):
                own_letters = np.zeros(max(len(model.langs), 1))
                places = []
                for first, last, language in own:
                    a, b = firsts[at] + first, firsts[at] + last
                    own_letters[language] += int((ends[a : b + 1] - starts[a : b + 1]).sum())
                    places.append({"start": int(starts[a] - begins[at]), "length": int(ends[b] - starts[a]), "lang": model.langs[language]})
                labels.append(model.langs[int(own_letters.argmax())] if own else UNKNOWN)
                shares.append(float(own_letters.max() / own_letters.sum()) if own else 0.0)
                placed.append(places)
            yield {"rest": batch.column("rest"), "text": batch.column("text"), "lang_pred": labels, "score": shares, "spans": placed}

    added = T.StructType.fromDDL("lang_pred string, score double, spans array<struct<start:int,length:int,lang:string>>")
    schema = T.StructType(packed.schema.fields + added.fields)
    return batches.map_arrow(packed, step, schema)


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts
