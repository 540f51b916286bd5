"""Models, tokens, languages, pages and lists: brute force, round trips and held-out accuracy."""

import datetime as dt
import hashlib
import math
import os
import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import example, given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from minutary.llm import bpe, html, langid, ngrams, ordinal, queries, urls

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# ---- n-grams ----

TEXTS = {
    1: "the cat sat on the mat the cat ran",
    2: "The dog sat on the Mat\tand the cat sat",
    3: "a dog ran  on a mat",
    4: "the the the a a cat sat on on",
    5: None,
    6: "",
    7: "unseen words only",
    8: "mat on cat dog the a ran sat and the dog ran on the mat " * 40,
}


@pytest.mark.parametrize("order", [2, 3])
def test_ngrams_equal_brute_force(make_docs, order, monkeypatch):
    monkeypatch.setattr(ngrams, "TOKENS_PER_CHUNK", 7)
    docs = make_docs(TEXTS)
    taught = [1, 2, 3, 4, 5, 8]
    model = ngrams.learn(docs.filter(F.col("doc_id").isin(taught)), order)
    plain = brute.KneserNey([TEXTS[doc] for doc in taught], order)
    raw, total = plain.raw, sum(plain.raw.values())
    for row in ngrams.score_texts(docs, model).select("rest.doc_id", "*").collect():
        tokens = [*brute.words(TEXTS[row.doc_id]), "</s>"]
        base = sum(np.log10((raw[t] + 0.1) / (total + 0.1 * (len(raw) + 1))) for t in tokens)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(raw[t] > 0 for t in tokens), total)
        assert row.base_score == pytest.approx(base, rel=1e-12)
        assert row.score == pytest.approx(plain.score(TEXTS[row.doc_id]), rel=1e-9)
        assert row.perplexity == pytest.approx(10 ** (-row.score / len(tokens)))


def test_ngram_chances_sum_to_one():
    plain = brute.KneserNey([text for text in TEXTS.values() if text], 2)
    for context in ["the", "cat", "never seen"]:
        assert sum(plain.chance((context, word)) for word in [*plain.raw, "new"]) == pytest.approx(1.0)


def test_the_query_scores_with_trigrams(make_docs, spark, tmp_path):
    make_docs(TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    found = {row.doc_id: row.score for row in queries.QUERIES["op3_ngrams"](spark, str(tmp_path)).collect()}
    plain = brute.KneserNey([text for doc, text in TEXTS.items() if zlib.crc32(str(doc).encode()) % 10], 3)
    assert found == {doc: pytest.approx(plain.score(text), rel=1e-9) for doc, text in TEXTS.items()}


def test_hashes_of_words_keep_all_bits():
    words, _ = ngrams.token_hashes([[b"cat", b"dog"]], 3)
    assert words[2:4].tolist() == [xxhash.xxh64_intdigest(b"cat"), xxhash.xxh64_intdigest(b"dog")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_packed_grams_are_whole(order):
    draw = np.random.default_rng(order)
    words = draw.integers(0, 1 << 64, 40, dtype=np.uint64)
    numbers = np.minimum(draw.zipf(1.3, (500, order)), 40).astype(np.uint64)
    for own in (numbers, numbers[:1], words[numbers - np.uint64(1)]):
        raw, at = ngrams._pack(own)
        assert (ngrams._unpack(raw) == own[at]).all() and sorted(at.tolist()) == list(range(len(own)))
    counts = np.array([[1, 0], [1 << 33, 2], [3, 255]])
    assert (np.stack(ngrams._unsqueezed(ngrams._small(counts)), axis=1) == counts).all()


@pytest.mark.parametrize("bits", [2, 9, 17])
def test_kept_arrays_find_every_key_and_no_other(bits, tmp_path):
    draw = np.random.default_rng(bits)
    shard = 3
    # Neighbours differ in the last bit, and keys of equal last 48 bits in the bits before.
    some = draw.integers(0, 1 << 60, 3000, dtype=np.uint64)
    near = np.concatenate([some, some ^ np.uint64(1), some ^ np.uint64(1 << 49)])
    drawn = np.unique((near & np.uint64((1 << 64 - bits) - 1)) | np.uint64(shard << 64 - bits))
    known, absent = drawn[::2], drawn[1::2]
    counts = draw.integers(0, 300, (len(known), 2))
    ngrams._save(str(tmp_path), "x", shard, bits, known, counts)
    model = ngrams.NgramModel(str(tmp_path), 3, bits)
    model.shards["x"] = {shard}
    assert (model.look_up("x", known[::-1], 2) == counts[::-1]).all()
    assert not model.look_up("x", absent, 2).any()


@pytest.mark.parametrize("size", [0, 1, 2, 1000, 5000])
def test_keys_are_sorted_by_all_their_bits(size):
    draw = np.random.default_rng(size)
    # Many keys agree in their first bits, and some in all.
    keys = draw.integers(0, 40, size, dtype=np.uint64) << np.uint64(56) | draw.integers(0, 50, size, dtype=np.uint64)
    found, order = ngrams._sorted(keys)
    assert order.tolist() == np.argsort(keys, kind="stable").tolist()
    assert found.tolist() == keys[order].tolist()
    distinct, at, places = ngrams._distinct(keys)
    assert distinct.tolist() == np.unique(keys).tolist() == keys[at].tolist()
    assert (distinct[places] == keys).all()


def test_scoring_opens_a_shard_once_and_searches_different_ngrams_only(make_docs, monkeypatch):
    model = ngrams.learn(make_docs(TEXTS))
    for kind, shards in model.shards.items():
        assert len(os.listdir(f"{model.folder}/{kind}")) == len(shards)
    searched, opened, search, mapped = [], [], ngrams._search, ngrams._mapped
    monkeypatch.setattr(ngrams, "_search", lambda known, ends, keys, bits: searched.extend(keys.tolist()) or search(known, ends, keys, bits))
    monkeypatch.setattr(ngrams, "_mapped", lambda path: opened.append(path) or mapped(path))
    scores = []
    for times in (1, 50):
        searched.clear()
        words, _ = ngrams.token_hashes([TEXTS[doc].encode().split() for doc in (1, 8)] * times, 3)
        logs, _ = model.score(words)
        scores.append((len(searched), logs[: len(words) // times].tolist()))
    # Only the n-grams over the border of two texts are new among the fifty.
    assert scores[1][0] <= scores[0][0] + 10 and len(opened) == len(set(opened))
    assert scores[1][1][2:] == scores[0][1][2:]


def test_ngrams_of_nothing(make_docs):
    docs = make_docs(TEXTS)
    empty = ngrams.learn(docs.limit(0))
    assert {row.score for row in ngrams.score_texts(docs, empty).collect()} == {0.0}
    assert ngrams.score_texts(docs.limit(0), empty).count() == 0
    with pytest.raises(ValueError):
        ngrams.mounted("hdfs://name/folder")


# ---- tokens ----


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


odd_letters = st.text(st.one_of(st.sampled_from(" \n\t\r'sdmlt1é日!.\x0b\x1c\x85\xa0 "), st.characters(codec="utf-8", max_codepoint=0x1FFFF)), max_size=60)


@given(odd_letters)
@example("<|endoftext|>a<|endoftext|> <|endoftext|>")
@example("a" * 3000 + "!" * 500 + " " * 300)
@settings(max_examples=300, deadline=None)
def test_bpe_equals_the_library(tokenizer, text):
    automaton = bpe.compile_tokenizer(TOKENIZER)
    wanted = tokenizer.encode(text, add_special_tokens=False).ids
    found = automaton.encode(text)
    assert np.frombuffer(found, dtype="<u4").tolist() == wanted
    assert automaton.decode(found).decode() == tokenizer.decode(wanted, skip_special_tokens=False)


def test_bpe_rows(make_docs, tokenizer):
    rows = [(1, "Hello  wörld"), (1, "Hello  wörld"), (2, None), (3, ""), (None, "x<|endoftext|>")]
    docs = make_docs(rows)
    found = sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded).decode(), r.n_tokens) for r in bpe.encode_texts(docs, TOKENIZER).select("rest.doc_id", "*").collect()), key=repr)
    wanted = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc, np.array(ids, dtype="<u4").tobytes(), text or "", len(ids)))
    assert found == sorted(wanted, key=repr)
    assert bpe.encode_texts(docs.limit(0), TOKENIZER).count() == 0


def test_merge_automaton_of_repeats():
    # a a -> aa, aa aa -> aaaa: the leftmost merge comes first.
    labels = [b"a", b"b", b"aa", b"aaaa", b"aab"]
    merges = [(0, 0, 2), (2, 2, 3), (2, 1, 4)]
    allowed, states = bpe._merge_states([0, 1], merges, 5)
    automaton = bpe.MergeAutomaton(labels, {}, np.arange(5), states, allowed)

    def by_merging(word):
        tokens = list(word)
        for u, v, w in merges:
            at, out = 0, []
            while at < len(tokens):
                pair = tokens[at : at + 2] == [u, v]
                out.append(w if pair else tokens[at])
                at += 2 if pair else 1
            tokens = out
        return tokens

    rng = random.Random(0)
    for _ in range(300):
        word = [rng.randrange(2) for _ in range(rng.randrange(1, 14))]
        assert automaton.word(b"".join(labels[c] for c in word)) == by_merging(word)


# ---- languages ----

EN, FR, RU = "the house with of and that is green", "le maison avec de et que est verte", "дом и зелёный с что это"


def taught(make_docs, spark):
    rows = [(n, " ".join([text] * 5), lang) for n, (text, lang) in enumerate([(EN, "en"), (FR, "fr"), (RU, "ru")] * 4)]
    return langid.learn(make_docs(rows))


def test_languages_of_spans(make_docs, spark):
    model = taught(make_docs, spark)
    assert model.langs == ["en", "fr", "ru"]
    mixed = f"1. {EN} {EN}! {FR} {FR} {RU}"
    texts = {1: EN, 2: FR.upper(), 3: RU, 4: mixed, 5: None, 6: "", 7: "12 %% 🙂", 8: "日本語", 9: f"{EN} " * 3000}
    found = {r.doc_id: r for r in langid.identify(make_docs(texts), model).select("rest.doc_id", "*").collect()}
    assert {n: found[n].lang_pred for n in (1, 2, 3, 4, 5, 6, 7, 9)} == {1: "en", 2: "fr", 3: "ru", 4: "en", 5: "und", 6: "und", 7: "und", 9: "en"}
    assert found[8].lang_pred in model.langs
    assert [s.lang for s in found[4].spans] == ["en", "fr", "ru"]
    cut = [mixed[s.start : s.start + s.length] for s in found[4].spans]
    assert cut == [f"{EN} {EN}", f"{FR} {FR}", RU]
    assert found[1].score == 1.0 and 0 < found[4].score < 1 and found[5].score == 0.0
    assert langid.identify(make_docs(texts).limit(0), model).count() == 0


def test_languages_without_any_learned(make_docs):
    model = langid.learn(make_docs([(1, "some text", None), (2, None, "en")]))
    assert {r.lang_pred for r in langid.identify(make_docs([(1, EN), (None, None)]), model).collect()} == {"und"}


def test_word_scores_equal_plain_ones(make_docs, spark):
    """Letter counts, weights and word scores, each written out for single letters and words."""
    model = taught(make_docs, spark)
    lower, script = langid.letter_tables()

    def bucket(before, letter, after):
        mixed = ((ord(before) if before else 0) * 0x9E3779B1 + ord(letter)) * 0x85EBCA77 + (ord(after) if after else 0)
        return mixed * 0x9E3779B97F4A7C15 % 2**64 >> 49

    def places(word):
        return [bucket(word[at - 1] if at else "", word[at], word[at + 1] if at + 1 < len(word) else "") for at in range(len(word))]

    logs = {}
    for text, lang in ((EN, "en"), (FR, "fr"), (RU, "ru")):
        counts = Counter(place for word in (" ".join([text] * 5)).split() for place in places(word) for _ in range(4))
        total = sum(counts.values()) + langid.SMOOTHING * langid.BUCKETS
        logs[lang] = lambda place, counts=counts, total=total: math.log((counts[place] + langid.SMOOTHING) / total)
    text = f"3 {EN.upper()}, xyz! {FR} {RU} {RU}ж."
    codes, letters, _ = langid._letters([text], lower)
    starts, ends, scores = langid.word_scores(codes, letters, script, model)
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    assert [text[a:b].lower() for a, b in zip(starts, ends)] == words
    for word, found in zip(words, scores):
        cyrillic = "а" <= word[0] <= "я"
        for at, lang in enumerate(model.langs):
            if (lang == "ru") == cyrillic:
                assert found[at] == pytest.approx(sum(map(logs[lang], places(word))), rel=1e-4)
            else:
                assert found[at] < scores[:, model.langs.index("en")].max() - 100


def test_best_spans_equal_plain_viterbi():
    rng = np.random.default_rng(0)
    counts = np.array([0, 7, 1, 30, 30, 0, 12])
    firsts = np.cumsum(counts) - counts
    scores = rng.standard_normal((int(counts.sum()), 3)) * 2
    found = langid.best_spans(scores, firsts, counts, 1.5)
    for spans, first, count in zip(found, firsts, counts):
        labels = [lang for a, b, lang in spans for _ in range(a, b + 1)]
        assert len(labels) == count
        value = sum(scores[first + at, lang] for at, lang in enumerate(labels)) - 1.5 * sum(a != b for a, b in zip(labels, labels[1:]))
        best = np.zeros(3)
        for at in range(count):
            best = np.maximum(best, best.max() - 1.5) + scores[first + at] if at else scores[first].copy()
        assert value == pytest.approx(best.max() if count else 0.0)


def test_language_held_out_accuracy(spark, sf):
    found = queries.QUERIES["op7_langid"](spark, sf).filter("held_out")
    joined = found.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


# ---- grades ----


def test_grades_on_held_out_documents(make_docs, spark):
    rng = random.Random(6)
    plain = [f"word{n}" for n in range(60)]
    texts, grades = {}, []
    for n in range(600):
        grade = n % 3
        own = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        if grade == 1:
            own = [f"{word}%%%" for word in own]
        if grade == 0:
            own[rng.randrange(len(own))] = rng.choice(["awful", "vile"])
        texts[n] = " ".join(own)
        grades.append((n, grade))
    texts |= {1000: None, 1001: "", 1002: "word1 " * 40_000}
    docs = make_docs(texts)
    rated = spark.createDataFrame([*grades[:450], (None, 1), (5, None), (7, 9)], "doc_id long, grade int")
    model = ordinal.learn(docs, rated, levels=3)
    assert model.thresholds[0] < model.thresholds[1]
    found = {r.doc_id: r for r in ordinal.grade_texts(docs, model).select("rest.doc_id", "*").collect()}
    assert all(1 >= r.tails[0] >= r.tails[1] >= 0 for r in found.values())
    assert all(r.expected_grade == pytest.approx(sum(r.tails)) for r in found.values())
    right = [round(found[n].expected_grade) == grade for n, grade in grades[450:]]
    assert sum(right) / len(right) >= 0.95
    assert found[1000].value == found[1001].value == 0.0
    values = model.values([texts[n].encode() for n in range(20)])
    assert values == pytest.approx([found[n].value for n in range(20)])
    assert ordinal.grade_texts(docs.limit(0), model).count() == 0


def test_grades_of_no_ratings(make_docs, spark):
    docs = make_docs({1: "some text"})
    model = ordinal.learn(docs, spark.createDataFrame([], "doc_id long, grade int"), levels=3)
    row = ordinal.grade_texts(docs, model).first()
    assert row.value == 0.0 and row.tails == [0.5, 0.5]


def test_ordinal_fit_finds_what_made_the_grades():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(400)
    grades = np.digitize(2 * x + rng.logistic(size=400), [-1.0, 1.5])
    weights, thresholds = ordinal.fit(np.arange(400), np.zeros(400, dtype=int), x, grades, 1, 3)
    assert weights[0] == pytest.approx(2, abs=0.5)
    assert thresholds == pytest.approx([-1.0, 1.5], abs=0.5)


@pytest.mark.parametrize("levels", [2, 3, 5])
def test_ordinal_fit_ends_where_numeric_gradients_vanish(levels, monkeypatch):
    """The loss, written out row by row, is flat where the fit ends, and higher a step away from it."""
    monkeypatch.setattr(ordinal, "STEPS", 3000)
    monkeypatch.setattr(ordinal, "RATE", 0.02)
    rng = np.random.default_rng(levels)
    rows, width = 200, 3
    x = rng.standard_normal((rows, width))
    grades = np.digitize(x @ [1.0, -0.5, 0.0] + rng.logistic(size=rows), np.linspace(-1, 1, levels - 1))
    owner, column = np.divmod(np.arange(rows * width), width)
    weights, thresholds = ordinal.fit(owner, column, x.ravel(), grades, width, levels)

    def loss(point):
        w, cuts = point[:width], [-math.inf, *point[width:], math.inf]
        total = 0.0
        for row, grade in zip(x, grades):
            value = float(row @ w)
            high, low = (1 / (1 + math.exp(-(cut - value))) if math.isfinite(cut) else float(cut > 0) for cut in (cuts[grade + 1], cuts[grade]))
            total -= math.log(high - low)
        return total / rows + ordinal.PENALTY / 2 * float(w @ w)

    end = np.concatenate([weights, thresholds])
    for at in range(len(end)):
        step = np.zeros(len(end))
        step[at] = 1e-5
        assert abs(loss(end + step) - loss(end - step)) / 2e-5 < 2e-3
        assert loss(end + 3000 * step) > loss(end) < loss(end - 3000 * step)


@given(st.lists(st.text(alphabet="aB1-é \n", max_size=30), max_size=5))
@settings(max_examples=80, deadline=None)
def test_ordinal_features_equal_plain_ones(texts):
    owner, bucket, shares = ordinal.features([text.encode() for text in texts])
    for at, text in enumerate(texts):
        words = text.encode().split()
        hashes = [xxhash.xxh64_intdigest(word.lower(), 7) for word in words]
        assert sorted(bucket[owner == at].tolist()) == sorted({h % ordinal.BUCKETS for h in hashes})
        plain = np.zeros(ordinal.SHAPES + 1)
        for nth, word in enumerate(words):
            symbols = sum(not (chr(b).isalnum() or b > 127) for b in word)
            shape = any(65 <= b <= 90 for b in word) + 2 * any(97 <= b <= 122 or b > 127 for b in word) + 4 * any(48 <= b <= 57 for b in word)
            plain[shape + (8 if symbols == 1 else 16 if symbols else 0)] += 1
            plain[-1] += nth > 0 and hashes[nth] == hashes[nth - 1]
        assert shares[at] == pytest.approx(plain / max(len(words), 1))


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use <div>cookies</div></div><div id="sideBar">side</div><!-- <p>no</p> -->
<article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>
 line<br>next&nbsp;one <p>Unclosed &lt;tag&gt; a &copy; 3 < 4<form><p>mail</p></form>
<div class="ads">Buy</div><p hidden>secret</p><ul><li>x</li><li>y</li></ul></article>
<section class="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; me</footer></body></html>"""


def test_page_blocks():
    blocks, known = html.page_blocks(PAGE)
    assert known
    assert blocks == ["Title & more", "One bold line next one", "Unclosed <tag> a © 3 < 4", "x", "y"]


@pytest.mark.parametrize("text, blocks", [("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<nav>x", []), ("<script>x", []), ("a<!-- b", ["a"]), ("<main><p>m</p></main><p>n</p>", ["m"]), ("<p title='>'>q</p>", ["q"])])
def test_odd_pages(text, blocks):
    assert html.page_blocks(text)[0] == blocks


@pytest.mark.parametrize("text, blocks", [
    ('<article><p class="ad">buy<p>body one<p>body two</article>', ["body one", "body two"]),
    ('<article><ul><li class="share">s<li>x<li>y</ul><p>z</article>', ["x", "y", "z"]),
    ('<article><dl><dt class="notice">s<dd>x</dl><p>z</article>', ["x", "z"]),
    ('<article><table><tr><td class="related">s<td>x<tr class="ad"><td>t<tr><td>y</table>z</article>', ["x", "y", "z"]),
    ('<div><article><div class="ads"><p>buy</article></div><article>z</article>', ["z"]),
    ('<div><aside>side</div><p>z</p>', ["z"]),
    ('<article><ul class="menu"><li>a<ul><li>b</ul></ul>z</article>', ["z"]),
    ('<article><a class="ad">buy<p>more</a>z</article>', ["z"]),
    ('<head><meta charset="x"><title>t</title><body><p>z', ["z"]),
    ('<article><svg-icon></svg-icon>x<style-guide>y</style-guide><title-bar>z</title-bar></article>', ["xyz"]),
    ('<article>x<template-part>y</template-part><svg class="i" /> z</article>', ["xy z"]),
    ('<article>x<svg><g/><title/><path d="m"/></svg>y<template><p>no</p></template>z<style>p{}</style >!</article>', ["xyz!"]),
    ('<div><article>x<svg><path></article>y</div>', ["x"]),
    ('<article>x<svg><path><p>y</article>', ["x", "y"]),
    ('<main><p>the long text of a page</p><article>card</article></main>', ["the long text of a page", "card"]),
    ('<main><p>the long text of a page</p></main><article>card</article>', ["the long text of a page"]),
    ('<main><p>by me</p><article>the long text of a page</article></main>', ["the long text of a page"]),
])
def test_ends_left_out_and_names_alike(text, blocks):
    assert html.page_blocks(text) == (blocks, "<article" in text or "<main" in text)


def test_pages_without_an_article(spark):
    menu = "home news sport weather travel money food about us"

    def story(n):
        return " ".join(f"s{n}w{at}" for at in range(12))

    def page(n):
        return f"<p>{menu}</p><p>{story(n)}</p>"

    rows = [(n, f"http://A.example:80/{n}", page(n)) for n in range(6)]
    rows += [(20, "http://b.example/1", page(99)), (21, "http://a.example/9", None), (21, None, "<article>x  y</article>")]
    rows += [(30 + n, "http://c.example/1", page(7)) for n in range(4)]
    rows += [(40 + n, "http://a.example/x", f"<article><p>{menu}</p></article>") for n in range(4)]
    pages = spark.createDataFrame([(*row, "z") for row in rows], "page_id long, url string, html string, host string")
    found = sorted((r.page_id, r.text) for r in html.main_text(pages).select("rest.page_id", "text").collect())

    wanted = [(n, story(n)) for n in range(6)] + [(20, f"{menu}\n{story(99)}"), (21, ""), (21, "x y")]
    wanted += [(30 + n, f"{menu}\n{story(7)}") for n in range(4)] + [(40 + n, menu) for n in range(4)]
    assert found == sorted(wanted)
    assert html.main_text(pages.limit(0)).count() == 0


def test_repeats_are_sought_on_all_pages(spark):
    """Menus of pages with an article tell what goes on one without; a line on most pages goes from articles
    too, one on few stays, and no article is emptied."""
    menu, letter = "home news sport weather travel money food about us", "read more stories like this one in our letter"
    quote = "a line that some but not most pages quote"

    def story(n):
        return " ".join(f"s{n}w{at}" for at in range(12))

    def article(n, more=""):
        return f"<div>{menu}</div><article><p>{story(n)}</p>{more}<div>{letter}</div></article>"

    html_of = {n: article(n, f"<p>{quote}</p>" if n < 3 else "") for n in range(8)}
    html_of |= {8: f"<div>{menu}</div><p>{story(8)}</p>", 9: f"<article>{letter}</article>"}
    pages = spark.createDataFrame([(n, "http://a.example/", page) for n, page in html_of.items()], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.main_text(pages).select("rest.page_id", "text").collect()}
    assert found == {n: story(n) + (f"\n{quote}" if n < 3 else "") for n in range(9)} | {9: letter}


@pytest.mark.parametrize(
    "page, blocks",
    [
        ('<article><p>a</p><section class="related-work">w</section></article>', ["a", "w"]),
        ('<article><div class="social-science">s</div><p id="notice-period">n</p></article>', ["s", "n"]),
        ('<article><p title="a hidden gem" data-hidden-at="3">g</p></article>', ["g"]),
        ("<article>x<!-- c --!>y<!-->z<!--->w</article>", ["xyzw"]),
        ("<article>a<p hidden>n<p HIDDEN=''>n<p style='display: none'>n<p aria-hidden=true>n</article>", ["a"]),
        ('<article>x<div class="ad-wrapper">n</div><div class="sidebarWrapper">n</div><ins class="adsbygoogle">n</ins></article>', ["x"]),
        ('<article>x<ul class="commentlist">n</ul><div class="user-reviews">n</div><div id="comment-12">n</div></article>', ["x"]),
        ("<article>x<noframes><p>n</p></noframes><noembed>n</noembed></article>", ["x"]),
        ('<div class="with-sidebar no-ads"><article>x</article></div>', ["x"]),
    ],
)
def test_names_attributes_and_comments(page, blocks):
    assert html.page_blocks(page) == (blocks, True)


def test_copies_of_a_story_on_a_small_host_stay(spark):
    story = " ".join(f"word{n}" for n in range(30))
    html_of = {n: f"<article><p>Edition {n}</p><p>{story if n < 3 else f'other{n} ' * 20}</p><p>writer{n}</p></article>" for n in range(6)}
    pages = spark.createDataFrame([(n, "http://s.example/", page) for n, page in html_of.items()], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.main_text(pages).select("rest.page_id", "text").collect()}
    assert all(found[n] == f"Edition {n}\n{story}\nwriter{n}" for n in range(3))


def _plain_main_text(rows, run, least_pages):
    """The rule of `main_text`, by all substrings of `run` tokens in dictionaries."""
    parsed = [(number, host, *html.page_parts(page)) for number, host, page in rows]
    texts, seen = {}, {}
    for _, host, blocks, others, _ in parsed:
        if blocks:
            texts.setdefault(host, set()).add(tuple(blocks))
            for own in (blocks, others):
                words = " ".join(own).lower().split()
                for at in range(len(words) - run + 1):
                    seen.setdefault((host, *words[at : at + run]), set()).add(tuple(blocks))
    found = []
    for number, host, blocks, _, known in parsed:
        words = " ".join(blocks).lower().split()
        gone = set()
        for at in range(len(words) - run + 1):
            count = len(seen[(host, *words[at : at + run])])
            if count >= least_pages and (not known or count >= html.SHARE * len(texts[host])):
                gone.update(range(at, at + run))
        if known and 2 * (len(words) - len(gone)) <= len(words):
            gone = set()
        left, at = [], 0
        for block in blocks:
            kept = [word for nth, word in enumerate(block.split(), at) if nth not in gone]
            at += len(block.split())
            left += [" ".join(kept)] if kept else []
        found.append((number, "\n".join(left)))
    return sorted(found)


@pytest.mark.parametrize("run", [1, 4, 8])
def test_repeats_equal_a_plain_search(spark, run):
    """Hosts with copies, near copies, shared lines and pages of both kinds, some only of the one."""
    draw = random.Random(run)
    words = [f"w{n}" for n in range(40)]
    lines = [" ".join(draw.choices(words, k=draw.randint(1, 14))) for _ in range(8)]
    rows = []
    for number in range(120):
        host = draw.choice(["a", "a", "b", "c", "d"])
        if rows and draw.random() < 0.25:
            # A copy or a near copy of an earlier page, perhaps on another host.
            page = draw.choice(rows)[2]
            page = page.replace("w3 ", f"n{number} ") if draw.random() < 0.5 else page
        else:
            blocks = [draw.choice(lines) if draw.random() < 0.5 else " ".join(draw.choices(words, k=draw.randint(0, 20))) for _ in range(6)]
            inner = "".join(f"<p>{block}</p>" for block in blocks[:4])
            marked = host == "b" or (host in "ad" and draw.random() < 0.6)
            page = f"<div>{blocks[4]}</div>" + (f"<article>{inner}</article>" if marked else inner) + f"<div>{blocks[5]}</div>"
        rows.append((number, host, page))
    pages = spark.createDataFrame([(n, f"https://{host}/{n}", page) for n, host, page in rows], "page_id long, url string, html string")
    found = sorted((r.page_id, r.text) for r in html.main_text(pages.repartition(5), run).select("rest.page_id", "text").collect())
    assert found == _plain_main_text(rows, run, html.PAGES)
    untouched = [(number, "\n".join(html.page_blocks(page)[0])) for number, _, page in rows]
    assert sum(one != other for one, other in zip(found, untouched)) > 20


def test_every_run_holds_its_least_inner_run():
    """Runs alike have the same key wherever they stand."""
    draw = np.random.default_rng(3)
    tokens = draw.integers(0, 1 << 63, 9, dtype=np.uint64)[draw.integers(0, 9, 3000)]
    for run in (1, 2, 5, 8):
        least = html._least_inner(tokens, run)
        keys = {}
        for at, key in enumerate(least.tolist()):
            assert keys.setdefault(tokens[at : at + run].tobytes(), key) == key
        assert len(least) == 3000 - run + 1


def test_sample_pages_keep_their_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = queries.QUERIES["op10_html"](spark, sf).collect()
    assert {r.page_id for r in found} == set(pages)
    import re
    from html import unescape

    for row in found:
        inner = re.search("<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        plain = [" ".join(unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split("</?(?:p|h1)>", re.sub("</?b>", "", inner))]
        assert row.text == "\n".join(part for part in plain if part)
        assert row.n_chars == len(row.text)


# ---- lists ----


def test_lists_by_day(spark):
    day = lambda n: dt.date(2024, 5, n)
    entries = spark.createDataFrame(
        [("bad.example", day(3), True), ("bad.example", day(7), False), ("bad.example", day(9), True), ("bad.example", day(9), False),
         ("ok.example/x", day(1), True), ("gone.example", day(2), False), (None, day(1), True), ("z.example", None, True), ("bad.example", day(3), True)],
        "key string, listed_on date, listed boolean",
    )
    rows = [
        (1, "http://bad.example/a", day(2), None), (2, "HTTPS://user@WWW.Bad.Example.:8080/a?q#f", day(3), "bad.example"), (3, "http://bad.example", day(6), "bad.example"),
        (4, "http://bad.example", day(7), None), (5, "http://bad.example", day(9), "bad.example"), (6, "http://notbad.example/", day(5), None),
        (7, "http://ok.example/x/y.html", day(5), "ok.example/x"), (8, "http://ok.example/xy", day(5), None), (9, "http://gone.example/", day(5), None),
        (10, None, day(5), None), (11, "no url", day(5), None), (12, "http://bad.example", None, None), (2, "http://bad.example", day(3), "bad.example"),
    ]
    captures = spark.createDataFrame([(n, url, on, "k") for n, url, on, _ in rows], "n long, url string, fetched_on date, key string")
    found = sorted((r.n, r.entry) if r.blocked else (r.n, None) for r in urls.judge(captures, entries).select("row.n", "*").collect())
    assert found == sorted([(n, entry) for n, _, _, entry in rows], key=lambda x: x[0])
    assert not any(r.blocked for r in urls.judge(captures, entries.limit(0)).collect())
    assert urls.judge(captures.limit(0), entries).count() == 0


def test_digests_follow_from_texts(spark, sf):
    rows = queries.QUERIES["op6_bpe"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = Tokenizer.from_file(TOKENIZER)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
