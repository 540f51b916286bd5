"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_REPEATS the runs per query
(the median counts), BENCH_QUERIES a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from minutary import catalog  # noqa: E402
from minutary.session import build_session  # noqa: E402

HEADLINE = [
    "speaker_stats",
    "meeting_stats",
    "talk_totals_cube",
    "handoffs",
    "turn_flow",
    "stitch_turns",
    "sentences",
    "tokens",
    "agenda_asof",
    "interruptions",
    "key_terms",
    "key_phrases",
    "key_sentences",
    "central_sentences",
    "topic_shifts",
    "segments",
    "cue_items",
    "search_turns",
    "assemble_minutes",
    "render_minutes",
    "live_counts",
    "live_sessions",
    "session_minutes",
    "redact",
    "stream_counts",
    "stream_running_minutes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", cores)
    queries = catalog.queries()
    # One small job first, so that starting up is not charged to the first query.
    queries["read_turns"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            begun = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
