"""Time operators on even meetings and with a third of all turns in one meeting.

    python scripts/skew.py [turns]

The turns are made by Spark in a fresh folder under /tmp. Equal times mean that no task
is left alone with the large meeting.
"""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from minutary.operators import joins, shaping, talk, terms, topics  # noqa: E402
from minutary.session import build_session  # noqa: E402
from minutary.streaming import live  # noqa: E402

LIMIT = 1 << 17

OPERATORS = {
    "speaker_stats": talk.speaker_stats,
    "handoffs": talk.handoffs,
    "turn_flow": talk.turn_flow,
    "stitch_turns": shaping.stitch_turns,
    "interruptions": lambda turns: joins.interruptions(turns, LIMIT),
    "live_sessions": lambda turns: live.live_sessions(turns, 60, LIMIT),
    "key_terms": lambda turns: terms.key_terms(turns, 5),
    "key_sentences": lambda turns: terms.key_sentences(turns, 3),
    "central_sentences": lambda turns: terms.central_sentences(turns, 3),
    "topic_shifts": lambda turns: topics.topic_shifts(turns, 3),
}


def made_turns(spark: SparkSession, count: int, hot: bool) -> DataFrame:
    number = F.col("id")
    in_hot = number < (count // 3 if hot else 0)
    turn = F.when(in_hot, number).otherwise(number % 100)
    word = F.pmod(F.xxhash64("id", F.col("at")), F.pow(F.lit(10), 1 + F.col("at") % 5).cast("long"))
    letters = F.translate(word.cast("string"), "0123456789", "abcdefghij")
    words = spark.range(0, count, 1, 32).select("id", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("at"))
    texts = words.select("id", "at", letters.alias("word")).groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("text")
    )
    start = F.timestamp_seconds(F.lit(1_700_000_000) + turn * 7)
    return texts.select(
        F.when(in_hot, F.lit(-1)).otherwise(F.floor(number / 100)).alias("meeting_id"),
        turn.alias("turn"),
        F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("string")).alias("speaker"),
        F.regexp_replace("text", "^((?:[a-j]+ ){6}[a-j]+) ", "$1. ").alias("text"),
        start.alias("started_at"),
        (start + F.expr("INTERVAL 20 SECONDS")).alias("ended_at"),
    )


def main() -> None:
    count = int(sys.argv[1]) if len(sys.argv) > 1 else 300_000
    spark = build_session("skew", partitions=64)
    folder = tempfile.mkdtemp(prefix="spark-skew-", dir="/tmp")
    seconds: dict[str, list[float]] = {}
    for hot in (False, True):
        path = f"{folder}/{'hot' if hot else 'even'}"
        made_turns(spark, count, hot).write.parquet(path)
        turns = spark.read.parquet(path)
        for name, operator in OPERATORS.items():
            begun = time.perf_counter()
            operator(turns).write.format("noop").mode("overwrite").save()
            seconds.setdefault(name, []).append(time.perf_counter() - begun)
    print(f"{'operator':20} {'even':>8} {'hot':>8}")
    for name, (even, hot) in seconds.items():
        print(f"{name:20} {even:8.1f} {hot:8.1f}")


if __name__ == "__main__":
    main()
