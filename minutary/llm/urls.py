"""Which captures of web pages were on a block list on the day they were fetched.

Dated entries become intervals of validity. A capture asks for its host, the domains above it, and the
paths above it on its host, each on its day; the different questions are few, so they are put
together first, and an as-of join gives each the interval in force. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from minutary.session import settle


def host_of(url: str = "url") -> Column:
    """The host in lower case, without user, port and last dot; empty if there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.rtrim(found, F.lit("."))


def path_parts(url: str = "url") -> Column:
    """The path cut at slashes, without empty parts; case matters."""
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda part: part != "")


def keys_of(url: str = "url") -> Column:
    """What a list entry may name to cover a URL: each domain of two or more labels that its host
    ends with (or a host of one label), and its host with each leading part of the path."""
    host, parts = host_of(url), path_parts(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda at: F.array_join(F.slice(labels, at, F.size(labels)), ".")
    )
    paths = F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda at: F.concat_ws("/", host, F.array_join(F.slice(parts, F.lit(1), at), "/"))
        )
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to) of a history (key, listed_on, listed): days when a key is on the list.

    An entry holds from its day until the key's next one; valid_to is that day, null if there is none.
    If a day has several entries for a key, being listed wins. Rows without key, day or
    state are no entries.
    """
    dated = entries.dropna(subset=["key", "listed_on", "listed"]).groupBy("key", "listed_on").agg(F.max("listed").alias("listed"))
    # A key has one row per day at most, so its window is bounded by the calendar.
    order = Window.partitionBy("key").orderBy("listed_on")
    stated = dated.select("key", "listed_on", "listed", F.lead("listed_on").over(order).alias("valid_to"))
    return stated.filter("listed").select("key", F.col("listed_on").alias("valid_from"), "valid_to")


def as_of(questions: DataFrame, valid: DataFrame) -> DataFrame:
    """(key, day, valid_from) for the different `questions` (key, day) whose key is listed that day."""
    asked = questions.select("key", "day", F.lit(1).alias("_kind"), F.lit(None).cast("struct<valid_from:date,valid_to:date>").alias("_span"))
    known = valid.select("key", F.col("valid_from").alias("day"), F.lit(0).alias("_kind"), F.struct("valid_from", "valid_to").alias("_span"))
    order = Window.partitionBy("key").orderBy("day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    latest = known.unionByName(asked).withColumn("_span", F.last("_span", ignorenulls=True).over(order)).filter("_kind = 1")
    open_or_later = F.col("_span.valid_to").isNull() | (F.col("day") < F.col("_span.valid_to"))
    return latest.filter(F.col("_span").isNotNull() & open_or_later).select("key", "day", "_span.valid_from")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(row, blocked, n_entries, entry, listed_on) for every row of `captures` (url, fetched_on, anything else).

    `row` is the row itself as a struct. `entry` is the longest key that covers the capture (of equally
    long ones the last in order), `listed_on` the day its interval began. A capture without day or host is
    covered by nothing. Repeated rows are each returned. Empty tables: nothing is blocked, or no rows.
    """
    # Written, so that a capture keeps its number.
    numbered = settle(captures.select(F.struct("*").alias("row")).withColumn("_id", F.monotonically_increasing_id()))
    asked = numbered.select("_id", F.col("row.fetched_on").cast("date").alias("day"), F.explode(keys_of("row.url")).alias("key")).filter("day IS NOT NULL")
    valid = intervals(entries)
    questions = asked.select("key", "day").distinct().join(valid.select("key").distinct(), "key", "left_semi")
    active = as_of(questions, valid)
    found = F.struct(F.length("key").alias("size"), "key", "valid_from")
    hits = asked.join(active, ["key", "day"]).groupBy("_id").agg(F.count("*").alias("n_entries"), F.max(found).alias("_best"))
    return numbered.join(hits, "_id", "left").select(
        "row",
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.col("_best.key").alias("entry"),
        F.col("_best.valid_from").alias("listed_on"),
    )
