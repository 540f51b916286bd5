"""Every operator as a query over the sample tables.

Conversations stand in for transcripts. They carry no times, so timed operators run on
events: a user is a meeting, an event a turn, its type the speaker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from minutary import schemas
from minutary.functions import cues, hooks
from minutary.operators import copies, index, items, joins, likeness, publishing, related, search, shaping, talk, terms, topics
from minutary.plans import minutes
from minutary.session import settle, tune, work_dir
from minutary.sources import checks, sinks, transcripts
from minutary.streaming import feeds, live, sinks as live_sinks, state

Query = Callable[[SparkSession, str], DataFrame]

MASKS = [
    publishing.Rule("article", "(?<![^ ])(?:the|die|la)(?= )", "*"),
    publishing.Rule("number", "[0-9]+", "#"),
    publishing.Rule("preposition", "(?<= )(?:of|de|von)(?= )", "~"),
]


def talk_of(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.read_turns(spark, f"{sf}/conversations.parquet", mapping=schemas.CONVERSATIONS_AS_TURNS)


def spoken_of(spark: SparkSession, sf: str) -> DataFrame:
    """Talk in which turns take turns between the languages of the cues."""
    langs = F.array(*[F.lit(lang) for lang in ("en", "de", "fr", "es")])
    return talk_of(spark, sf).withColumn("lang", F.get(langs, (F.col("turn") % 4).cast("int")))


def activity_of(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.read_turns(spark, f"{sf}/events.parquet", mapping=schemas.EVENTS_AS_TURNS)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema(schemas.EVENTS).parquet(f"{sf}/events.parquet")


def timed_of(spark: SparkSession, sf: str) -> DataFrame:
    """Events with an end: each lasts `value` hours."""
    micros = F.round(F.col("value") * 3600).cast("long") * 1_000_000
    start = F.col("ts").cast("timestamp")
    return _events(spark, sf).select(
        F.col("user_id").alias("meeting_id"),
        F.col("event_id").alias("turn"),
        F.col("event_type").alias("speaker"),
        start.alias("started_at"),
        F.timestamp_micros(F.unix_micros(start) + micros).alias("ended_at"),
    )


def flawed_of(spark: SparkSession, sf: str) -> DataFrame:
    """Events as turns with repeated and skipped numbers, blank texts and no speaker."""
    return _events(spark, sf).select(
        F.col("user_id").alias("meeting_id"),
        F.floor("value").alias("turn"),
        F.expr("nullif(event_type, 'error')").alias("speaker"),
        F.when(F.col("props").contains("7"), "  ").otherwise(F.col("props")).alias("text"),
    )


def roster_of(turns: DataFrame) -> DataFrame:
    """Everybody but the system is invited, and a chair who never speaks."""
    people = turns.filter("speaker <> 'system'").select("meeting_id", "speaker").distinct()
    chairs = turns.select("meeting_id", F.lit("chair").alias("speaker")).distinct()
    named = people.unionByName(chairs)
    return named.select(
        "meeting_id", "speaker", F.concat_ws(" ", "speaker", "meeting_id").alias("name"), F.lit("member").alias("role")
    )


def promises_of(turns: DataFrame) -> DataFrame:
    """Sentences with an owner and a date, some of them impossible, and without."""
    day = F.concat(
        F.lit("2024-"),
        F.lpad((F.col("turn") % 12 + 1).cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad((F.length("text") % 33).cast("string"), 2, "0"),
    )
    promise = F.concat("speaker", F.lit(" will answer by "), day)
    return turns.select(
        "meeting_id",
        "turn",
        F.lit(0).alias("pos"),
        F.when(F.col("speaker") == "system", F.lit("Noted for the record")).otherwise(promise).alias("sentence"),
    )


def _clock(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _rejects(spark, sf):
    return checks.check_turns(flawed_of(spark, sf))[1]


def _clean(spark, sf):
    return checks.check_turns(flawed_of(spark, sf))[0]


def _stitched(spark, sf):
    runs = shaping.stitch_turns(activity_of(spark, sf))
    return runs.select("meeting_id", "turn", "speaker", "turns", "text")


def _roster(how: str) -> Query:
    def run(spark, sf):
        turns = talk_of(spark, sf)
        columns = ["meeting_id", "turn", "speaker"] + (["name"] if how == "left" else [])
        return joins.roster_join(turns, roster_of(turns), how).select(*columns)

    return run


def _absentees(spark, sf):
    turns = talk_of(spark, sf)
    return joins.absentees(turns, roster_of(turns)).select("meeting_id", "speaker", "name")


def _agenda(spark, sf):
    everything = activity_of(spark, sf)
    agenda = everything.filter("speaker = 'signup'").select(
        "meeting_id", F.col("turn").alias("item"), F.col("text").alias("title"), F.col("started_at").alias("starts_at")
    )
    turns = everything.filter("speaker <> 'signup'").select("meeting_id", "turn", "started_at")
    return joins.agenda_asof(turns, agenda).select("meeting_id", "turn", "item", "title")


def _totals(mode: str) -> Query:
    return lambda spark, sf: talk.talk_totals(talk_of(spark, sf), mode)


def _segments(spark, sf):
    turns = talk_of(spark, sf)
    words = settle(terms.turn_words(turns))
    return topics.segments(turns, topics.topic_shifts(turns, 2, words=words), words=words)


def _promises(spark, sf):
    found = items.item_fields(promises_of(talk_of(spark, sf)))
    return found.select("meeting_id", "turn", "owner", F.col("due").cast("string").alias("due"))


def _open(spark, sf):
    everything = activity_of(spark, sf)
    raised = everything.filter("speaker = 'signup'").select(
        F.col("turn").alias("event_id"), F.col("meeting_id").alias("item_id"), F.col("started_at").alias("opened_at")
    )
    done = everything.filter("speaker = 'purchase'").select(
        F.col("meeting_id").alias("item_id"), F.col("started_at").alias("done_at")
    )
    return items.open_items(raised, done).select("event_id", "item_id")


def _assembled(spark, sf):
    """The nested minutes, with each section put into one text."""

    def text(section: str, line):
        joined = F.array_join(F.transform(section, line), "\n")
        return F.coalesce(joined, F.lit("")).alias(section)

    built = minutes.assemble_minutes(spoken_of(spark, sf))
    return built.select(
        "meeting_id",
        "part",
        "first_turn",
        "last_turn",
        "turns",
        text("speakers", lambda s: F.concat_ws(" ", s["speaker"], s["turns"], s["chars"])),
        text("key_terms", lambda t: t["term"]),
        text("topics", lambda t: F.concat_ws(" ", t["first_turn"], t["last_turn"], t["terms"])),
        text("summary", lambda s: s["sentence"]),
        text("items", lambda i: F.concat_ws(" ", i["turn"], i["pos"], i["kind"], i["sentence"])),
    )


def _rendered(spark, sf):
    return minutes.render_minutes(minutes.assemble_minutes(spoken_of(spark, sf)))


def _versions(spark, sf, speakers: list[str]) -> DataFrame:
    stats = talk.meeting_stats(shaping.select_turns(talk_of(spark, sf), speakers=speakers))
    return publishing.with_version(stats, ["meeting_id"])


def _compared(spark, sf):
    old = _versions(spark, sf, ["user", "system"])
    new = _versions(spark, sf, ["assistant", "system"])
    return publishing.compare_minutes(old, new, ["meeting_id"])


def _length_lines(spark, sf, speaker: str) -> DataFrame:
    turns = shaping.select_turns(talk_of(spark, sf), speakers=[speaker])
    return turns.select("meeting_id", (F.length("text") % 50).alias("remainder"))


def _newer(spark, sf):
    return publishing.newer_lines(_length_lines(spark, sf, "assistant"), _length_lines(spark, sf, "user"))


def _kept(spark, sf):
    return publishing.kept_lines(_length_lines(spark, sf, "assistant"), _length_lines(spark, sf, "user"))


def _redacted(spark, sf):
    return publishing.redact(talk_of(spark, sf), MASKS).select("meeting_id", "turn", "text")


def _redacted_twice(spark, sf):
    """How many turns a second run changes."""
    once = publishing.redact(talk_of(spark, sf), MASKS).withColumn("again", F.col("text"))
    twice = publishing.redact(once, MASKS, column="again")
    return twice.agg(F.count("*").alias("turns"), F.count_if(F.col("again") != F.col("text")).alias("changed"))


def _close(estimate, exact):
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), 0.05 * exact)


def _vocabulary_check(spark, sf):
    """Estimates beside exact counts, by meeting."""
    turns = talk_of(spark, sf)
    exact = shaping.tokens(turns).groupBy("meeting_id").agg(F.countDistinct("word").alias("exact"))
    both = talk.vocabulary(turns).select("meeting_id", "words").join(exact, "meeting_id")
    return both.select("meeting_id", "exact", _close(F.col("words"), F.col("exact")).alias("close"))


def _merged_check(spark, sf):
    exact = shaping.tokens(talk_of(spark, sf)).agg(F.countDistinct("word").alias("exact"))
    estimate = _merged_vocabulary(spark, sf).scalar()
    return exact.select("exact", _close(estimate, F.col("exact")).alias("close"))


SHARES = [0.1, 0.5, 0.9]


def _sketched_lengths(spark, sf):
    """Quantiles from the merged sketches of all meetings: whether each has its rank, to within 0.03."""
    turns = talk_of(spark, sf)
    merged = talk.merged_lengths(talk.length_sketches(turns), SHARES).first()
    below = [F.avg((F.length("text") < merged[f"q{at}"]).cast("double")) for at in range(len(SHARES))]
    upto = [F.avg((F.length("text") <= merged[f"q{at}"]).cast("double")) for at in range(len(SHARES))]
    close = [(low <= share + 0.03) & (high >= share - 0.03) for low, high, share in zip(below, upto, SHARES)]
    rows = F.array(*[F.struct(F.lit(share).alias("share"), F.lit(merged.turns).alias("turns"), each.alias("close")) for share, each in zip(SHARES, close)])
    return turns.agg(rows.alias("rows")).select(F.inline("rows"))


def _without_mail(spark, sf):
    """Documents without e-mail addresses: a digest of the text, and how many there were."""
    mails = F.size(F.regexp_extract_all("text", F.lit(publishing.MAIL.pattern), F.lit(0))).cast("long")
    counted = _documents(spark, sf).select("doc_id", "text", mails.alias("mails"))
    return publishing.redact(counted, [publishing.MAIL]).select("doc_id", "mails", F.sha2("text", 256).alias("text_sha256"))


def _csv_turns(spark, sf):
    """The transcript written as CSV with its columns in another order, and read back."""
    path = work_dir(spark, "csv")
    written = talk_of(spark, sf).select("text", "speaker", "turn", "meeting_id")
    written.write.option("header", "true").option("escape", '"').csv(path)
    mapping = {name: name for name in ("meeting_id", "turn", "speaker", "text")}
    read = transcripts.read_turns(spark, path, "csv", mapping, multiLine="true")
    return read.select("meeting_id", "turn", "speaker", "text")


def _counts(spark, sf):
    counts = live.live_counts(activity_of(spark, sf), "1 hour")
    return counts.select(_clock("begins_at"), "speaker", "turns")


def _sliding(spark, sf):
    counts = live.live_sliding(activity_of(spark, sf), "1 hour", "30 minutes")
    return counts.select(_clock("begins_at"), "speaker", "turns")


def _sessions(spark, sf):
    spans = live.live_sessions(activity_of(spark, sf), 3600)
    return spans.select("meeting_id", F.unix_micros("begins_at").alias("begins_micros"), "turns")


def _guests(spark, sf):
    invited = activity_of(spark, sf).filter("speaker = 'signup'").select("meeting_id").distinct()
    return invited.select(
        "meeting_id",
        F.lit("click").alias("speaker"),
        F.concat_ws(" ", F.lit("guest"), "meeting_id").alias("name"),
        F.lit("guest").alias("role"),
    )


def _live_roster(spark, sf):
    return live.live_roster(activity_of(spark, sf), _guests(spark, sf)).select("meeting_id", "turn", "speaker", "name")


def _pairs(spark, sf):
    return live.live_pairs(activity_of(spark, sf), "click", "purchase", 6 * 3600)


def _session_minutes(spark, sf):
    found = live.session_minutes(activity_of(spark, sf), 3600)
    return found.select(
        "meeting_id", F.unix_micros("begins_at").alias("begins_micros"), "speaker", "turns", "chars", "last_speaker"
    )


# The following start a real stream over the events file, let it take what is there, and
# read the table it wrote.


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    # A pattern, since a stream takes a plain path for a folder; it fits the table as one
    # file and as a folder of files.
    return feeds.stream_turns(spark, f"{sf}/event[s].parquet", "10 minutes", mapping=schemas.EVENTS_AS_TURNS)


def _streamed(spark: SparkSession, label: str, stream: DataFrame) -> DataFrame:
    path = work_dir(spark, label)
    with state.rocksdb_state(spark):
        feeds.drain_to_table(stream, f"{path}/table", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def _stream_turns(spark, sf):
    return _streamed(spark, "turns", _feed(spark, sf).select("meeting_id", "turn", "speaker"))


def _stream_counts(spark, sf):
    counts = _streamed(spark, "counts", live.live_counts(_feed(spark, sf), "1 hour"))
    return counts.select(_clock("begins_at"), "speaker", "turns")


def _stream_sliding(spark, sf):
    counts = _streamed(spark, "sliding", live.live_sliding(_feed(spark, sf), "1 hour", "30 minutes"))
    return counts.select(_clock("begins_at"), "speaker", "turns")


def _stream_sessions(spark, sf):
    spans = _streamed(spark, "sessions", live.live_sessions(_feed(spark, sf), 3600))
    return spans.select("meeting_id", F.unix_micros("begins_at").alias("begins_micros"), "turns")


def _stream_replays(spark, sf):
    feed = _feed(spark, sf)
    fresh = live.drop_replays(feed.unionByName(feed), ["meeting_id", "turn"])
    return _streamed(spark, "replays", fresh.select("meeting_id", "turn", "speaker"))


def _stream_roster(spark, sf):
    named = live.live_roster(_feed(spark, sf), _guests(spark, sf))
    return _streamed(spark, "roster", named.select("meeting_id", "turn", "speaker", "name"))


def _stream_pairs(spark, sf):
    return _streamed(spark, "pairs", live.live_pairs(_feed(spark, sf), "click", "purchase", 6 * 3600))


def _stream_minutes(spark, sf):
    found = _streamed(spark, "running", state.running_minutes(_feed(spark, sf), 3600))
    return found.select(
        "meeting_id", F.unix_micros("begins_at").alias("begins_micros"), "speaker", "turns", "chars", "last_speaker"
    )


def _for_each(spark: SparkSession, label: str, stream: DataFrame, make_handler) -> str:
    path = work_dir(spark, label)
    query = (
        stream.writeStream.foreachBatch(make_handler(f"{path}/table"))
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f"{path}/table"


def _stream_late(spark, sf):
    """Two batches of one stream: clicks, then everything, so that all but the newest events of
    the second are late."""
    path = work_dir(spark, "late")
    everything = activity_of(spark, sf)
    stored = everything.withColumns({name: F.col(name).cast("timestamp_ntz") for name in transcripts.TIMES})
    for arrived in (stored.filter("speaker = 'click'"), stored):
        arrived.write.mode("append").parquet(f"{path}/in")
        query = (
            feeds.stream_turns(spark, f"{path}/in", "10 minutes")
            .writeStream.foreachBatch(live_sinks.split_late(path, 600))
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(f"{path}/late").select("meeting_id", "turn", "speaker")


def _stream_upsert(spark, sf):
    newest = _feed(spark, sf).select("meeting_id", "speaker", "turn", "started_at", "text")
    path = _for_each(
        spark, "upsert", newest, lambda table: live_sinks.upsert_sink(table, ["meeting_id", "speaker"], ["started_at", "turn"], 8)
    )
    return spark.read.parquet(path).select("meeting_id", "speaker", "turn", "text")


def _written(spark, sf):
    """Written twice, read once."""
    path = work_dir(spark, "minutes")
    stats = sinks.with_bucket(talk.meeting_stats(talk_of(spark, sf)), ["meeting_id"], 8)
    sinks.write_minutes(stats, path, ["bucket"])
    sinks.write_minutes(stats, path, ["bucket"])
    return spark.read.parquet(path).drop("bucket")


def _scored(spark, sf):
    scorer = hooks.sentence_scorer(lambda sentences: sentences.str.len())
    found = terms.key_sentences(talk_of(spark, sf), 2, scorer=scorer)
    return found.select("meeting_id", "turn", "pos", "score")


def _split(spark, sf):
    splitter = hooks.sentence_splitter(lambda text: text.split("\n"))
    return shaping.sentences(talk_of(spark, sf), splitter=splitter)


def _measured(spark, sf):
    reducer = hooks.speaker_measure("mean_commas", lambda texts: texts.str.count(","))
    return talk.speaker_stats(talk_of(spark, sf), reducer=reducer).select("meeting_id", "speaker", "turns", "mean_commas")


def _aggregated(spark, sf):
    """The median length of a speaker's texts, from counts of lengths."""

    def add(counts, texts):
        return counts + Counter(texts.dropna().str.len().tolist())

    def median(counts):
        lengths = sorted(counts.elements())
        middle = len(lengths) // 2
        return (lengths[middle] + lengths[~middle]) / 2.0 if lengths else None

    reducer = hooks.speaker_aggregate("median_chars", Counter, add, lambda a, b: a + b, median)
    return talk.speaker_stats(talk_of(spark, sf), reducer=reducer).select("meeting_id", "speaker", "turns", "median_chars")


def _merged_vocabulary(spark, sf):
    return talk.merged_vocabulary(talk.vocabulary(talk_of(spark, sf)))


def _cued_by_table(spark, sf):
    """The built-in cues as a table."""
    table = spark.createDataFrame([tuple(cue) for cue in cues.CUES], "kind string, lang string, pattern string")
    return items.cue_items(shaping.sentences(spoken_of(spark, sf), keep=("meeting_id", "turn", "lang")), table)


def _closed(spark, sf):
    """What users first say in a turn as actions, and what assistants do as reports; a tenth of the words is enough."""
    kind = F.when(F.col("speaker") == "user", F.lit("action")).when(F.col("speaker") == "assistant", F.lit("done"))
    first = shaping.sentences(talk_of(spark, sf), keep=("meeting_id", "turn", "speaker")).filter("pos = 0 AND speaker <> 'system'")
    told = first.select(F.concat_ws("-", "meeting_id", "turn").alias("item_id"), "meeting_id", "turn", "pos", kind.alias("kind"), "sentence")
    return items.closed_items(told, least=0.1).select("item_id", "closed_by")


def _indexed(spark, sf):
    """Turns added to an index in two parts, and asked for."""
    path, turns = work_dir(spark, "index"), talk_of(spark, sf)
    for part in (0, 1):
        index.add_to_index(turns.filter(F.col("meeting_id") % 2 == part), path)
    return index.search_index(spark, path, "the die la", 20)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


QUERIES: dict[str, Query] = {
    "read_turns": lambda s, d: talk_of(s, d).select("meeting_id", "turn", "speaker", "text"),
    "read_turns_csv": _csv_turns,
    "turn_rejects": _rejects,
    "turn_gaps": _clean,
    "write_minutes": _written,
    "select_turns": lambda s, d: shaping.select_turns(talk_of(s, d), ["user", "system"], "the", 200).select(
        "meeting_id", "turn", "text"
    ),
    "stitch_turns": _stitched,
    "sentences": lambda s, d: shaping.sentences(talk_of(s, d)),
    "tokens": lambda s, d: shaping.tokens(talk_of(s, d)),
    "roster_left": _roster("left"),
    "roster_invited": _roster("semi"),
    "roster_uninvited": _roster("anti"),
    "roster_absentees": _absentees,
    "agenda_asof": _agenda,
    "interruptions": lambda s, d: joins.interruptions(timed_of(s, d)),
    "speaker_stats": lambda s, d: talk.speaker_stats(talk_of(s, d)).drop("first_turn"),
    "meeting_stats": lambda s, d: talk.meeting_stats(talk_of(s, d)),
    "talk_totals_rollup": _totals("rollup"),
    "talk_totals_cube": _totals("cube"),
    "talk_totals_sets": _totals("sets"),
    "handoffs": lambda s, d: talk.handoffs(talk_of(s, d)),
    "handoffs_wide": lambda s, d: talk.handoffs(talk_of(s, d), wide=["assistant", "system", "user"]),
    "turn_flow": lambda s, d: talk.turn_flow(talk_of(s, d)),
    "balance": lambda s, d: talk.balance(talk_of(s, d)),
    "length_profile": lambda s, d: talk.length_profile(talk_of(s, d)),
    "vocabulary": lambda s, d: talk.vocabulary(talk_of(s, d)).select("meeting_id", "words"),
    "vocabulary_merged": _merged_vocabulary,
    "vocabulary_check": _vocabulary_check,
    "vocabulary_merged_check": _merged_check,
    "length_sketch_check": _sketched_lengths,
    "longest_turns": lambda s, d: talk.longest_turns(talk_of(s, d), 20),
    "key_terms": lambda s, d: terms.key_terms(talk_of(s, d), 5).drop("uses"),
    "key_phrases": lambda s, d: terms.key_terms(talk_of(s, d), 5, n=2).drop("uses"),
    "key_sentences": lambda s, d: terms.key_sentences(talk_of(s, d), 3),
    "central_sentences": lambda s, d: terms.central_sentences(talk_of(s, d), 3),
    "sentence_degrees": lambda s, d: likeness.sentence_degrees(talk_of(s, d), 0.2),
    "linked_sentences": lambda s, d: likeness.linked_sentences(talk_of(s, d), 3, 0.2),
    "turn_cosines": lambda s, d: topics.turn_cosines(talk_of(s, d)),
    "topic_shifts": lambda s, d: topics.topic_shifts(talk_of(s, d), 2),
    "segments": _segments,
    "topic_threads": lambda s, d: topics.topic_threads(terms.key_terms(talk_of(s, d), 5)),
    "related_meetings": lambda s, d: related.related_meetings(_vectors(s, d), 5),
    "near_copies": lambda s, d: copies.near_copies(_documents(s, d)),
    "cue_items": lambda s, d: items.cue_items(shaping.sentences(spoken_of(s, d), keep=("meeting_id", "turn", "lang"))),
    "cue_items_table": _cued_by_table,
    "closed_items": _closed,
    "item_fields": _promises,
    "open_items": _open,
    "search_turns": lambda s, d: search.search_turns(talk_of(s, d), "the die la", 20),
    "search_index": _indexed,
    "assemble_minutes": _assembled,
    "render_minutes": _rendered,
    "minutes_lines": lambda s, d: minutes.render_lines(minutes.minutes_tables(spoken_of(s, d))),
    "compare_minutes": _compared,
    "newer_lines": _newer,
    "kept_lines": _kept,
    "redact": _redacted,
    "redact_twice": _redacted_twice,
    "redact_mail": _without_mail,
    "redaction_counts": lambda s, d: publishing.redaction_counts(talk_of(s, d), MASKS),
    "live_counts": _counts,
    "live_sliding": _sliding,
    "live_sessions": _sessions,
    "live_roster": _live_roster,
    "live_pairs": _pairs,
    "session_minutes": _session_minutes,
    "stream_turns": _stream_turns,
    "stream_counts": _stream_counts,
    "stream_sliding": _stream_sliding,
    "stream_sessions": _stream_sessions,
    "stream_drop_replays": _stream_replays,
    "stream_roster": _stream_roster,
    "stream_pairs": _stream_pairs,
    "stream_running_minutes": _stream_minutes,
    "stream_split_late": _stream_late,
    "stream_upsert": _stream_upsert,
    "hook_scorer": _scored,
    "hook_splitter": _split,
    "hook_measure": _measured,
    "hook_aggregate": _aggregated,
}


def queries() -> dict[str, Query]:
    def tuned(query: Query) -> Query:
        return lambda spark, sf: query(tune(spark), sf)

    return {name: tuned(query) for name, query in QUERIES.items()}
