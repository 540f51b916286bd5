"""Near copies, containment and line dedup against brute force."""

import random

import brute
import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from minutary.llm import components as cc, decontaminate, hashing, lines, queries, simhash, vectors

VOCABULARY = [f"w{n}" for n in range(400)] + ["Ärger", "naïve", "日本", "x" * 40]


def prose(rng, size):
    return " ".join(rng.choice(VOCABULARY) for _ in range(size))


def edited(rng, text, changes):
    found = text.split(" ")
    for _ in range(changes):
        found[rng.randrange(len(found))] = rng.choice(VOCABULARY)
    return " ".join(found)


def sample_texts(seed=5):
    rng = random.Random(seed)
    texts = {n: prose(rng, rng.choice([0, 1, 2, 3, 4, 5, 30, 120, 900])) for n in range(40)}
    base = prose(rng, 600)
    texts |= {100 + n: edited(rng, base, rng.choice([0, 1, 2, 4])) for n in range(60)}
    texts |= {200: None, 201: "", 202: " \n\t ", 203: prose(rng, 30_000)}
    return texts


@given(st.lists(st.binary(max_size=70), max_size=30), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_span_hashes_equal_xxh64(parts, seed):
    text = b"".join(parts)
    ends = np.cumsum([len(part) for part in parts], dtype=np.int64)
    starts = ends - np.array([len(part) for part in parts], dtype=np.int64)
    assert hashing.xxh64_spans(text, starts, ends, seed).tolist() == [xxhash.xxh64_intdigest(part, seed) for part in parts]


def test_rolling_hash_does_not_depend_on_place():
    text = b"abcabcab"
    found = hashing.rolling_hashes(text, np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert found[0] == found[1] != found[2]


def test_components(spark):
    rng = random.Random(1)
    links = [(n, n + 1) for n in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(5, 5), (None, 3)]
    table = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    expected = brute.parts({x for link in real for x in link}, real)
    assert {row.node: row.component for row in cc.components(table).collect()} == expected
    assert cc.components(table.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [4, 128])
def test_simhash_equals_brute_force(make_docs, chunk):
    texts = sample_texts()
    found = {r.doc_id: (f"{r.bits & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_copies(make_docs(texts), chunk).collect()}
    assert found == brute.near_copies(texts)


def test_simhash_odd_rows(make_docs):
    same = [(7, "a b c d"), (7, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "only here now"), (9, None), (8, "")]
    docs = make_docs(same)
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()), key=repr)
    assert found == sorted([(7, 3), (7, 3), (3, 3), (None, 3), (None, None), (9, 8), (8, 8)], key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, None, 8], key=repr)
    assert simhash.near_copies(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_manhattan_never_exceeds_hamming():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    bound = simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b))
    assert (bound <= np.bitwise_count(a ^ b)).all() and bound.max() > 0


def test_leaks_equal_brute_force(make_docs, spark):
    rng = random.Random(8)
    items = {n: prose(rng, rng.choice([1, 2, 3, 4, 5, 6, 12, 40, 90])) for n in range(30)} | {90: None, 91: "", 92: "  "}
    docs = sample_texts(9)
    for n, item in items.items():
        tokens = (item or "").split()
        cut = " ".join(tokens[: int(len(tokens) * rng.choice([0.7, 0.85, 1.0]))])
        docs[1000 + n] = f"{prose(rng, 200)}\n{cut.upper()} {prose(rng, 200)}"
        docs[2000 + n] = item
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontaminate.leaks(make_docs(docs), table)
    assert {(r.doc_id, r.item_id): r.found for r in found.collect()} == brute.leaks(docs, items)
    clean = decontaminate.without_leaks(make_docs(docs), table)
    assert {r.doc_id for r in clean.collect()} == set(docs) - {doc for doc, _ in brute.leaks(docs, items)}


def test_short_items_inside_long_documents(make_docs, spark):
    items = spark.createDataFrame([(1, "Zyxo"), (2, "zyxo qua"), (3, "b zyxo qua c"), (4, "a b c d e")], "item_id long, text string")
    filler = "m n o p q r s t " * 200
    docs = make_docs([(1, f"{filler} b ZYXO\tqua c {filler}"), (2, "zyxo"), (3, "qua zyxo"), (4, f"{filler}zyxos"), (5, "a b c d"), (6, "b zyxo qua c")])
    found = decontaminate.leaks(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (6, 1), (6, 2), (6, 3)]
    assert all(r.shingles == r.found == 1 for r in found.collect())
    plain = duckdb.connect()
    for table, name in ((docs, "documents"), (items, "benchmark")):
        plain.register(name, table.select("text", *(c for c in ("doc_id", "item_id") if c in table.columns)).toPandas())
    assert sorted(plain.sql(queries.SQL["op1_decontaminate"]).fetchall()) == sorted((r.doc_id, r.item_id, r.shingles, r.found) for r in found.collect())


def test_leaks_odd_rows(make_docs, spark):
    passage = "one two three four five six seven"
    items = spark.createDataFrame([(1, passage), (1, passage), (None, "a b c d e f"), (2, None)], "item_id long, text string")
    docs = make_docs([(5, passage), (5, passage), (5, "other words"), (None, "x a b c d e f y"), (6, None)])
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()), key=repr)
    assert found == [(5, 1), (None, None)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [5, 6]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == 5


def line_texts():
    rng = random.Random(4)
    common = ["The same long line in every document", "\t a line with SPACES around it \x0b", "überall die gleiche lange Zeile", "too short"]
    texts = {}
    for n in range(300):
        own = [f"line number {n} of its own, place {k}" for k in range(rng.randrange(4))]
        own += [line.upper() if rng.random() < 0.3 else line for line in common if rng.random() < 0.6] * rng.choice([1, 1, 2])
        own += [f"shared by few documents, {n % 120}"]
        rng.shuffle(own)
        texts[n] = "\n".join(own)
    return texts | {1000: None, 1001: "", 1002: "\n\n", 1003: "x" * 50_000}


@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_lines_equal_brute_force(spark, make_docs, partitions):
    texts = line_texts()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = lines.drop_repeated_lines(make_docs(texts)).select("rest.doc_id", "n_dropped", F.col("text").cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.doc_id: (r.n_dropped, r.text) for r in rows} == brute.kept_lines(texts)


def test_lines_odd_rows(make_docs):
    line = "a line that is long enough to count"
    docs = make_docs([(1, line), (1, line), (1, f"{line}\nmore"), (2, line), (None, line), (None, f"x\n{line}")])
    found = lines.drop_repeated_lines(docs).select("rest.doc_id", F.col("text").cast("string"), "n_lines", "n_dropped")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(1, "", 1, 1), (1, "", 1, 1), (1, "more", 2, 1), (2, line, 1, 0), (None, "", 1, 1), (None, "x", 2, 1)], key=repr
    )
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


def test_repeated_rows_give_each_line_once(make_docs, monkeypatch):
    notice = "all rights reserved by the owners"
    inputs, run = [], lines.batches.map_arrow
    monkeypatch.setattr(lines.batches, "map_arrow", lambda df, *more: inputs.append(df) or run(df, *more))
    keep = lines.keep_bitmaps(make_docs([(1, f"a\n{notice}\nb")] * 50 + [(n, notice) for n in (2, 3)]))
    assert {row.doc_id: list(row.gone) for row in inputs[-1].collect()} == {1: [1], 2: [0]}
    assert keep.count() == 2


def test_bitmaps_keep_lines_beyond_them():
    keep = lines._pack(np.array([1, 3]))
    text = "\n".join("abcdefghijkl").encode()
    assert lines.lines_left(text, keep) == ([c.encode() for c in "acefghijkl"], 12)
    assert lines.lines_left(b"", None) == ([b""], 1)


@pytest.mark.parametrize("chunk", [8, 256])
def test_vectors_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(2)
    rows = []
    for at in range(12):
        centre = rng.standard_normal(16)
        for _ in range(12 if at else 60):
            rows.append((centre + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2])).tolist())
    table = [(n, row, n % 2) for n, row in enumerate(rows)]
    table += [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("nan")] * 16, 1), (904, rows[0], None), (905, [1e30] * 16, 1), (906, [2e30] * 16, 1), (907, [1.0], 1), (908, [], 1)]
    table += [(n + 2000, row, n % 2) for n, row in enumerate(rows[:5])]
    frame = spark.createDataFrame([(*row, "x") for row in table], "vec_id long, embedding array<double>, label int, bucket string")
    usable = {v: (np.array(e) / np.linalg.norm(np.array(e) / max(map(abs, e))) / max(map(abs, e)), l) for v, e, l in table if l is not None and e and None not in e and np.isfinite(e).all() and any(e)}
    links = [(a, b) for a, (x, l) in usable.items() for b, (y, m) in usable.items() if a < b and l == m and len(x) == len(y) and x @ y >= 0.93]
    counts = {v: sum(v in link for link in links) for v, _, _ in table}
    component = brute.parts(counts, links)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_copies(frame, chunk=chunk).collect()}
    assert found == {v: (counts[v], component[v], v == component[v]) for v in counts}
    assert vectors.near_copies(frame.limit(0)).count() == 0


def test_vectors_odd_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (None, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_copies(frame).collect()), key=repr)
    assert found == sorted([(1, 1, 1), (1, 1, 1), (1, 1, 1), (None, 1, 1), (None, 0, None)], key=repr)


def test_buckets_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    rows = vectors.unit(rng.standard_normal((50, 64)))
    whole = vectors.buckets(rows)
    assert all((vectors.buckets(rows[at : at + 1])[0] == whole[at]).all() for at in range(50))
