"""The kept index against search over the text, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from minutary.operators import index, search


def talk(rng, turns):
    words = [f"w{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(60)] + ["the"] * 40
    return [(rng.randrange(5), n, "a", " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 30, 90])))) for n in range(turns)]


@pytest.mark.parametrize("query", ["the", "waa", "the wab", ["waa wac", "the wbb"], "the nowhere", "nowhere"])
@pytest.mark.parametrize("k", [1, 300])
def test_index_answers_like_a_scan(spark, make_turns, tmp_path_factory, rows, query, k, cache={}):
    if not cache:
        cache["rows"] = talk(random.Random(4), 900) + [(None, 1, "a", "the waa"), (7, None, "a", "waa"), (7, 2, "a", None)]
        cache["path"] = str(tmp_path_factory.mktemp("index"))
        for start in range(0, 903, 301):
            index.add_to_index(make_turns(*cache["rows"][start : start + 301]), cache["path"])
        index.add_to_index(make_turns(), cache["path"])
    found = index.search_index(spark, cache["path"], query, k)
    assert rows(found) == rows(search.search_turns(make_turns(*cache["rows"]), query, k))


def test_index_reads_only_what_it_needs(spark, make_turns, tmp_path):
    rng = random.Random(8)
    rows = [(1, n, "a", "the " * rng.choice([1, 1, 1, 1, 9]) + " ".join(rng.choice(["waa", "wbb"]) for _ in range(9))) for n in range(6000)]
    index.add_to_index(make_turns(*rows), str(tmp_path))
    asked = index.Search(spark, str(tmp_path), "the", 10)
    last = asked.cutoffs()["the"]
    blocks = asked.headers.filter("term = 'the'")
    assert blocks.filter(F.col("block") <= last).count() < 0.3 * blocks.count()
    plan = asked.postings.select("block")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,the)" in plan and "ReadSchema: struct<term:string,block:bigint>" in plan
    assert "(bucket#" in plan.partition("PartitionFilters: [")[2].partition("]")[0]


def test_an_unfinished_addition_does_not_count(spark, make_turns, tmp_path, rows):
    path = str(tmp_path)
    index.add_to_index(make_turns((1, 1, "a", "the cat")), path)
    left = spark.read.parquet(f"{path}/postings")
    left.drop("segment").write.partitionBy("bucket").parquet(f"{path}/postings/segment=torn")
    assert rows(index.search_index(spark, path, "cat", 5), "meeting_id", "turn") == [(1, 1)]
