"""Conversations as training text: turns between marks, with a mask for the loss.

    <turn>          begins a message and its role
    <text>          ends the role and begins the first turn of the message
    <more>          begins a further turn of the same role
    </turn>         ends the message

Each mark is a line of its own. A mark inside a role or text gets a backslash in front, and reading takes
one away, whatever stood there before, so that every text comes back as it was. Turns are collected
as structs and sorted, neighbours of one role merged and the parts joined by expressions of Spark only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from minutary.operators import ordering

# The template: marks, and how they are told from the same letters in a text.
TURN, TEXT, MORE, END = "<turn>\n", "\n<text>\n", "\n<more>\n", "\n</turn>\n"
_MARKS = "(</?turn>|<text>|<more>)"
LEARNED_ROLE = "assistant"
# A longer conversation is written in several chunks, so that no task collects all of it.
TURNS_PER_CHUNK = 4096


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _MARKS, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + _MARKS, "$1")


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _chunks(turns: DataFrame, limit: int) -> DataFrame:
    """(conv_id, chunk, _turns, _goes_on, _opens, _closes): sorted structs of the turns of each chunk, whether
    it goes on with the message of the chunk before, and whether it is the first and the last.

    Where no conversation has more than `limit` turns, its id alone groups it, which is one shuffle.
    """
    known = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    packed = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns")
    largest = known.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        alone = {"chunk": F.lit(0).cast("long"), "_goes_on": F.lit(False), "_opens": F.lit(True), "_closes": F.lit(True)}
        return known.groupBy("conv_id").agg(packed).withColumns(alone)
    placed = ordering.block_by_range(known, ["conv_id"], ["turn", "role", "text"], limit)
    chunks = placed.groupBy("conv_id", F.col(ordering.BLOCK).cast("long").alias("chunk")).agg(packed)
    window = Window.partitionBy("conv_id").orderBy("chunk")
    ends = chunks.withColumns({"_first": F.element_at("_turns", 1)["role"], "_last": F.element_at("_turns", -1)["role"]})
    beside = ends.withColumns({"_before": F.lag("_last").over(window), "_after": F.lead("_first").over(window)})
    goes_on = F.coalesce(F.col("_before") == F.col("_first"), F.lit(False))
    return beside.withColumns({"_goes_on": goes_on, "_opens": F.isnull("_before"), "_closes": F.isnull("_after")})


def format_turns(turns: DataFrame, learned: str = LEARNED_ROLE, limit: int = TURNS_PER_CHUNK) -> DataFrame:
    """One row per chunk of a conversation: (conv_id, chunk, n_turns, formatted, mask).

    `mask` has an entry per turn, in order: `marks` code points of template, which are never
    learned, and then `chars` code points of text, learned if `loss`, that is, if the role is
    `learned`. What is left at the end of the last chunk is template. A conversation is one chunk unless some conversation has
    more than `limit` turns; chunks of one are cut between turns, and their texts in order of `chunk` are
    the conversation's text, in which a message may run on from one chunk to the next.

    Turns go by number, those without one first; turns of the same number go by role and text, and
    a repeated row is a turn again. A null role or text counts as empty. Turns without a conversation are one
    conversation, whose id is null. An empty table gives no row. Other columns are not looked at.
    """
    chunks = _chunks(turns, limit)
    at = F.col("_turns")
    places = F.sequence(F.lit(0), F.size(at) - 1)

    def starts_message(place: Column) -> Column:
        same_as_before = F.get(at, place - 1)["role"] == F.get(at, place)["role"]
        return F.when(place == 0, ~F.col("_goes_on")).otherwise(~same_as_before)

    def mark(place: Column) -> Column:
        """What stands before the text of a turn."""
        close = F.when((place > 0) | ~F.col("_opens"), F.lit(END)).otherwise(F.lit(""))
        opening = F.concat(close, F.lit(TURN), escaped(F.get(at, place)["role"]), F.lit(TEXT))
        return F.when(starts_message(place), opening).otherwise(F.lit(MORE))

    def piece(place: Column) -> Column:
        turn = F.get(at, place)
        return F.struct(
            mark(place).alias("mark"), escaped(turn["text"]).alias("text"), (turn["role"] == learned).alias("loss")
        )

    pieces = chunks.select("conv_id", "chunk", "_closes", F.transform(places, piece).alias("_pieces"))
    text = _joined(F.transform("_pieces", lambda each: F.concat(each["mark"], each["text"])))
    entry = lambda each: F.struct(
        F.length(each["mark"]).alias("marks"), F.length(each["text"]).alias("chars"), each["loss"].alias("loss")
    )
    return pieces.select(
        "conv_id",
        "chunk",
        F.size("_pieces").cast("long").alias("n_turns"),
        F.concat(text, F.when(F.col("_closes"), F.lit(END)).otherwise(F.lit(""))).alias("formatted"),
        F.transform("_pieces", entry).alias("mask"),
    )


def whole(chunks: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) with the chunks of each conversation put together: one row,
    so a conversation has to fit into one."""
    packed = F.array_sort(F.collect_list(F.struct("chunk", "formatted", "mask")))
    found = chunks.groupBy("conv_id").agg(packed.alias("_chunks"))
    return found.select(
        "conv_id",
        _joined(F.transform("_chunks", lambda each: each["formatted"])).alias("formatted"),
        F.flatten(F.transform("_chunks", lambda each: each["mask"])).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add `turns`, an array of (role, text) as they were, and `learned`, the texts under the mask."""
    messages = F.filter(F.split("formatted", END), lambda message: message != "")

    def turns_of(message: Column) -> Column:
        parts = F.split(message, TEXT)
        role = F.get(parts, F.lit(0)).substr(F.lit(len(TURN) + 1), F.length(message))
        texts = F.split(F.get(parts, F.lit(1)), MORE)
        return F.transform(texts, lambda text: F.struct(role.alias("role"), text.alias("text")))

    raw = formatted.withColumn("_raw", F.flatten(F.transform(messages, turns_of)))
    clear = lambda turn: F.struct(unescaped(turn["role"]).alias("role"), unescaped(turn["text"]).alias("text"))
    masked = F.zip_with("_raw", "mask", lambda turn, part: F.when(part["loss"], turn["text"].substr(F.lit(1), part["chars"])))
    learned = F.transform(F.filter(masked, lambda text: text.isNotNull()), unescaped)
    return raw.withColumns({"turns": F.transform("_raw", clear), "learned": learned}).drop("_raw")
