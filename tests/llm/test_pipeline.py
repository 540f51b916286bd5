"""The pipeline against its plain version, stage by stage and as a whole."""

import hashlib
import random

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

BENCHMARK = {1: "alpha beta gamma delta epsilon zeta eta theta iota kappa", 2: None}


def documents():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("the", "house", "green", "with") for b in "abcdefghij"]
    prose = lambda size: " ".join(rng.choice(vocabulary) for _ in range(size))
    notice = "All rights reserved by the owners"
    texts = {n: f"{prose(40)}\n{notice if n % 3 else notice.upper()}\n{prose(10)}" for n in range(20)}
    texts[40] = texts[3]
    texts |= {50 + n: f"{prose(20)} {BENCHMARK[1].title()} {prose(20)}" for n in range(3)}
    texts |= {60: None, 61: "", 62: "12 34 !!", 63: "short", 64: f"{notice}\n{notice}", 65: notice}
    return texts


def plain(texts):
    kept = {n: text for n, text in texts.items() if any(c.isalpha() for c in text or "")}
    kept = {n: text for n, (_, text) in brute.kept_lines(kept).items()}
    copies = brute.near_copies(kept)
    kept = {n: text for n, text in kept.items() if copies[n][1] == n}
    leaked = {n for n, _ in brute.leaks(kept, BENCHMARK)}
    return {n: text for n, text in kept.items() if n not in leaked}


def test_pipeline_equals_its_plain_version(spark, make_docs, tmp_path):
    texts = documents()
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(BENCHMARK.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: (bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    wanted = {}
    for n, text in plain(texts).items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        wanted[n] = (np.array(ids, dtype="<u4").tobytes(), hashlib.sha256(text.encode()).hexdigest())
    assert found == wanted


def test_texts_stay_when_no_language_is_learned(spark, make_docs, tmp_path):
    texts = documents()
    make_docs([(n, text, None) for n, text in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(BENCHMARK.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {row.doc_id for row in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert found == set(plain(texts)) != set()


def test_stages_keep_the_columns(spark, make_docs, tmp_path):
    spark.createDataFrame(list(BENCHMARK.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "a plain text with letters"), (1, "a plain text with letters"), (None, None), (2, "x" * 100_000)]
    for docs in (make_docs(rows), make_docs(rows).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, str(tmp_path))
            assert kept.schema.simpleString() == docs.schema.simpleString(), name
            assert kept.count() <= docs.count()
