"""The plans are those wanted: pushed down, cut early, split when skewed."""

import re

from pyspark.sql import functions as F

from minutary import catalog
from minutary.operators import items, joins, search, shaping, talk, terms, topics
from minutary.plans import minutes
from minutary.session import settle


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def run_plan_of(df) -> str:
    df.collect()
    return plan_of(df)


def test_filter_and_columns_reach_the_scan(spark, sf):
    found = plan_of(shaping.select_turns(catalog.talk_of(spark, sf), ["user"]).select("meeting_id"))
    assert "PushedFilters: [In(role" in found or "EqualTo(role,user)" in found
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in found


def test_counts_combine_before_the_shuffle(spark, sf):
    found = plan_of(talk.speaker_stats(catalog.talk_of(spark, sf)))
    assert "partial_count" in found and "partial_sum" in found


def test_rankings_are_cut_before_the_shuffle(spark, sf):
    turns = catalog.talk_of(spark, sf)
    for found in (terms.key_terms(turns, 3), terms.key_sentences(turns, 3), terms.central_sentences(turns, 3), topics.topic_shifts(turns, 2)):
        shown = plan_of(found)
        assert re.search(r"WindowGroupLimit .* Partial", shown) and re.search(r"WindowGroupLimit .* Final", shown)


def test_longest_and_search_keep_k_rows_per_task(spark, sf):
    turns = catalog.talk_of(spark, sf)
    assert "TakeOrderedAndProject" in plan_of(talk.longest_turns(turns, 5))
    assert "TakeOrderedAndProject" in plan_of(search.search_turns(turns, "the", 5))


def test_words_are_split_and_shuffled_once(spark, sf):
    shown = run_plan_of(terms.term_weights(catalog.talk_of(spark, sf)))
    final = shown[: shown.rindex("== Initial Plan ==")]
    assert "ReusedExchange" in final
    assert final.count("Generate explode") == 1


def test_minutes_read_the_source_three_times(spark, sf):
    shown = run_plan_of(minutes.assemble_minutes(catalog.talk_of(spark, sf)))
    final = shown[: shown.rindex("== Initial Plan ==")]
    assert 1 <= len(re.findall(r"FileScan parquet [^\n]*conversations", final)) <= 3


def test_lines_of_minutes_read_the_heads_once_worked_out(spark, sf):
    """Key terms, topics and summary are taken from a table, not worked out again for each section."""
    shown = plan_of(minutes.render_lines(minutes.minutes_tables(catalog.talk_of(spark, sf))))
    assert shown.count("Window") == 0


def test_words_travel_as_arrays_to_the_cosines(spark, sf):
    turns = catalog.talk_of(spark, sf)
    shown = plan_of(topics.turn_cosines(turns, words=settle(terms.turn_words(turns))))
    # Counting by pair and word, and by pair, needs no shuffle of its own.
    assert shown[: shown.index("Generate explode")].count("Exchange") == 0


def test_items_need_no_shuffle(spark, sf):
    assert "Exchange" not in plan_of(items.cue_items(shaping.sentences(catalog.talk_of(spark, sf))))


def test_no_cross_joins(spark, sf):
    slow = {"agenda_asof", "roster_left", "key_terms", "key_sentences", "central_sentences", "segments", "search_turns", "cue_items", "topic_shifts", "interruptions"}
    queries = catalog.queries()
    for name in slow:
        shown = plan_of(queries[name](spark, sf))
        assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown, name


def test_hot_meeting_is_split_at_the_join(spark):
    """One meeting has nearly all turns; its part of the join runs as several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    turns = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(-1).alias("meeting_id"),
        F.col("id").alias("turn"),
        F.lit("ann").alias("speaker"),
        F.lit("words").alias("text"),
    )
    roster = turns.select("meeting_id", "speaker", F.lit("Ann").alias("name"), F.lit("r").alias("role")).distinct()
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = joins.roster_join(turns, roster)
        assert joined.count() == 200_000
        assert "skew=true" in run_plan_of(joined)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
