"""The minutes of a meeting: as tables, as one nested row, and as text.

The tables have no bound on a meeting: one row of sections of fixed length (key terms, topics, summary), and a row per
speaker and per item. The nested form packs these into arrays. A meeting of more than `part_turns` turns is then several
rows that each fit in a task, cut by count of turns, whatever their numbers; the sections about the whole meeting are in its first
part, a speaker is in the part where they first speak, an item in the part of its turn.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from minutary.functions import cues
from minutary.operators import items as it, ordering, publishing, shaping, talk, terms, topics
from minutary.session import settle

TURNS_PER_PART = 1000
KEYS = ["meeting_id", "part"]


class Tables(NamedTuple):
    """Minutes without arrays that grow: `heads` has a row per meeting, the others one per entry."""

    heads: DataFrame  # meeting_id, first_turn, last_turn, turns, key_terms, topics, summary
    speakers: DataFrame  # meeting_id, speaker, turns, chars, first_turn, share
    items: DataFrame  # meeting_id, turn, pos, kind, owner, due, sentence, item_id
    keys: DataFrame  # meeting_id, turn, speaker, chars


def _listed(rows: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Rows as an array of structs, in the order of `columns`."""
    packed = F.array_sort(F.collect_list(F.struct(*columns)))
    return rows.groupBy(*keys).agg(packed.alias(name))


def minutes_tables(
    turns: DataFrame,
    lexicon: list[cues.Cue] | DataFrame | None = None,
    terms_each: int = 5,
    sentences_each: int = 3,
    shifts_each: int = 2,
    block_turns: int = ordering.TURNS_PER_BLOCK,
    write_tables: bool = True,
) -> Tables:
    """The minutes as tables.

    The words of each turn feed key terms, summary, cosines and segments; with `write_tables` they
    are written to the shared folder once, with the keys, speakers and lengths of turns, and so are the
    counts of words by stretch, from which those by meeting follow, their weights, and the heads, which
    `render_lines` takes apart several times. The text itself is then read for cues and for the sentences picked.
    """
    kept = settle if write_tables else lambda rows: rows
    words = kept(terms.turn_words(turns.withColumn("chars", F.length("text")), ("speaker", "chars")))
    keys = words.select("meeting_id", "turn", "speaker", "chars")
    # A few rows per meeting, and read more than once.
    shifts = settle(topics.topic_shifts(keys, shifts_each, block_turns, words).select("meeting_id", "turn"))
    numbered = kept(topics.number_segments(keys.select("meeting_id", "turn", "speaker"), shifts, block_turns))
    counted = kept(topics.segment_terms(numbered, words))
    weights = kept(terms.term_weights(keys, words=counted))
    heads = keys.groupBy("meeting_id").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("turns")
    )
    own = ["lang"] if "lang" in turns.columns else []
    found = it.item_fields(it.cue_items(shaping.sentences(turns, keep=["meeting_id", "turn", "speaker", *own]), lexicon))
    key_terms = _listed(
        terms.key_terms(keys, terms_each, weights=weights), ["meeting_id"], ["rank", "term", "weight"], "key_terms"
    )
    summary = _listed(
        terms.key_sentences(turns, sentences_each, weights=weights, words=words),
        ["meeting_id"],
        ["turn", "pos", "sentence", "score"],
        "summary",
    )
    parts = topics.described(numbered, counted)
    stretches = _listed(parts, ["meeting_id"], ["segment", "first_turn", "last_turn", "speakers", "terms"], "topics")
    for section in (key_terms, stretches, summary):
        heads = ordering.join_on(heads, section, ["meeting_id"], "left")
    heads = kept(heads)
    people = talk.speaker_stats(keys).select("meeting_id", "speaker", "turns", "chars", "first_turn", "share")
    listed = found.select("meeting_id", "turn", "pos", "kind", "owner", "due", "sentence", "item_id")
    return Tables(heads, people, listed, keys)


def _parts(keys: DataFrame, part_turns: int, block_turns: int) -> DataFrame | None:
    """(meeting_id, turn, part) if some meeting needs parts: its turns are counted in order, without one task for them."""
    different = keys.select("meeting_id", "turn").distinct()
    if (different.groupBy("meeting_id").count().agg(F.max("count")).first()[0] or 0) <= part_turns:
        return None
    placed = ordering.block_by_turn(different, block_turns)
    counted = ordering.carry(placed, ["meeting_id"], {"_before": (F.count(F.lit(1)), "sum")})
    number = F.row_number().over(ordering.in_block(["meeting_id"], ["turn"])) + F.coalesce("_before", F.lit(0)) - 1
    return settle(counted.select("meeting_id", "turn", F.floor(number / part_turns).alias("part")))


def assemble_minutes(
    turns: DataFrame,
    lexicon: list[cues.Cue] | DataFrame | None = None,
    terms_each: int = 5,
    sentences_each: int = 3,
    shifts_each: int = 2,
    part_turns: int = TURNS_PER_PART,
    block_turns: int = ordering.TURNS_PER_BLOCK,
    write_tables: bool = True,
) -> DataFrame:
    """One row per meeting and part, with arrays in a fixed order and a `version`. See `minutes_tables`, which has
    no parts."""
    tables = minutes_tables(turns, lexicon, terms_each, sentences_each, shifts_each, block_turns, write_tables)
    cut = _parts(tables.keys, part_turns, block_turns)

    def parted(rows: DataFrame, turn: str) -> DataFrame:
        if cut is None:
            return rows.withColumn("part", F.lit(0).cast("long"))
        return ordering.join_on(rows, cut.withColumnRenamed("turn", turn), ["meeting_id", turn], "left")

    spine = parted(tables.keys, "turn").groupBy(*KEYS).agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("turns")
    )
    speakers = _listed(parted(tables.speakers, "first_turn"), KEYS, ["speaker", "turns", "chars", "share"], "speakers")
    listed = _listed(parted(tables.items, "turn"), KEYS, ["turn", "pos", "kind", "owner", "due", "sentence", "item_id"], "items")
    whole = tables.heads.select("meeting_id", F.lit(0).cast("long").alias("part"), "key_terms", "topics", "summary")
    rows = spine
    for section in (speakers, whole, listed):
        rows = ordering.join_on(rows, section, KEYS, "left")
    columns = [*KEYS, "first_turn", "last_turn", "turns", "speakers", "key_terms", "topics", "summary", "items"]
    return publishing.with_version(rows.select(*columns), KEYS)


def _lines(array: str, line) -> Column:
    """One text line per entry; an absent section has no lines."""
    return F.coalesce(F.transform(F.col(array), line), F.array().cast("array<string>"))


def _section(title: str, array: str, line) -> Column:
    lines = _lines(array, line)
    titled = F.concat(F.array(F.lit(""), F.lit(f"## {title}"), F.lit("")), lines)
    return F.when(F.size(lines) > 0, titled).otherwise(F.array().cast("array<string>"))


# Sections of the text, in order.
SECTIONS = ["Speakers", "Key terms", "Topics", "Summary", "Items"]


def _speaker_line(row) -> Column:
    return F.concat(F.lit("- "), row["speaker"], F.lit(": "), row["turns"], F.lit(" turns"))


def _topic_line(row) -> Column:
    terms_of = F.coalesce(row["terms"], F.lit(""))
    return F.concat(F.lit("- turns "), row["first_turn"], F.lit(" to "), row["last_turn"], F.lit(": "), terms_of)


def _item_line(row) -> Column:
    owner = F.coalesce(F.concat(F.lit(" (owner "), row["owner"], F.lit(")")), F.lit(""))
    due = F.coalesce(F.concat(F.lit(" (due "), row["due"].cast("string"), F.lit(")")), F.lit(""))
    return F.concat(F.lit("- "), row["kind"], F.lit(": "), row["sentence"], owner, due)


def render_lines(tables: Tables) -> DataFrame:
    """Minutes as lines of text, in any number: (meeting_id, section, place, pos, text). A meeting's lines in order of section, place, pos and
    text are its minutes; section 0 is the heading, and the others are numbered as in SECTIONS, without their titles.

    Speakers stand by name, items by turn and position; nothing is gathered by meeting.
    """
    none = F.lit(0).cast("long")
    heads, people, found = tables.heads, tables.speakers, tables.items

    def nested(section: int, array: str, line) -> DataFrame:
        rows = heads.select("meeting_id", F.posexplode(array).alias("_at", "_row"))
        return rows.select("meeting_id", F.lit(section).alias("section"), F.col("_at").cast("long").alias("place"), none.alias("pos"), line(F.col("_row")).alias("text"))

    parts = [
        heads.select("meeting_id", F.lit(0).alias("section"), none.alias("place"), none.alias("pos"), F.concat(F.lit("# Meeting "), F.col("meeting_id")).alias("text")),
        people.select("meeting_id", F.lit(1).alias("section"), none.alias("place"), none.alias("pos"), _speaker_line(people).alias("text")),
        nested(2, "key_terms", lambda row: F.concat(F.lit("- "), row["term"])),
        nested(3, "topics", _topic_line),
        nested(4, "summary", lambda row: F.concat(F.lit("- "), row["sentence"])),
        found.select("meeting_id", F.lit(5).alias("section"), F.col("turn").alias("place"), F.col("pos").cast("long").alias("pos"), _item_line(found).alias("text")),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines.filter("text IS NOT NULL")


def render_minutes(minutes: DataFrame) -> DataFrame:
    """Minutes as Markdown, one text per meeting and part."""
    heading = F.concat(F.lit("# Meeting "), F.col("meeting_id"))
    heading = F.when(F.col("part") > 0, F.concat(heading, F.lit(", part "), F.col("part") + 1)).otherwise(heading)
    lines = F.concat(
        F.array(heading),
        _section("Speakers", "speakers", _speaker_line),
        _section("Key terms", "key_terms", lambda t: F.concat(F.lit("- "), t["term"])),
        _section("Topics", "topics", _topic_line),
        _section("Summary", "summary", lambda s: F.concat(F.lit("- "), s["sentence"])),
        _section("Items", "items", _item_line),
    )
    return minutes.select(*KEYS, F.array_join(lines, "\n").alias("markdown"))
