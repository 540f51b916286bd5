"""Comparing minutes with an earlier version, and masking them before they go out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Rule(NamedTuple):
    name: str
    pattern: str
    replacement: str


# Fixed value: what is taken for an e-mail address.
MAIL = Rule("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[mail]")


def with_version(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add `version`, a hash of all columns but the keys; equal content, equal hash."""
    rest = [name for name in df.columns if name not in keys]
    return df.withColumn("version", F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256))


def compare_minutes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Each key with `added`, `removed`, `changed` or `same`. Only keys and hashes are
    shuffled, not the minutes."""
    before = old.select(*keys, F.col("version").alias("_old"))
    after = new.select(*[F.col(name).alias(f"_{name}") for name in keys], F.col("version").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed")
        .otherwise("same")
    )
    # A null key meets a null key.
    same = F.lit(True)
    for name in keys:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    either = [F.coalesce(name, f"_{name}").alias(name) for name in keys]
    return before.join(after, same, "full_outer").select(*either, change.alias("change"))


def newer_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` beyond those of `old`, counting repeats."""
    return new.exceptAll(old)


def kept_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Different rows found in both."""
    return new.intersect(old)


def masked(text: Column, rules: list[Rule]) -> Column:
    for rule in rules:
        text = F.regexp_replace(text, rule.pattern, rule.replacement)
    return text


def redact(df: DataFrame, rules: list[Rule], column: str = "text") -> DataFrame:
    """Apply the publisher's rules in turn to one text column. A second run changes nothing if
    no replacement makes a match of any rule, and patterns look at what is around a match
    (`(?<= )`, `(?= )`) rather than take it in: a space taken in is not there for the next."""
    return df.withColumn(column, masked(F.col(column), rules))


def redaction_counts(df: DataFrame, rules: list[Rule], column: str = "text") -> DataFrame:
    """How often each rule applies, each after the rules before it, in one pass."""
    hits, text = [], F.col(column)
    for at, rule in enumerate(rules):
        found = F.size(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
        hits.append(F.sum(found).cast("long").alias(f"h{at}"))
        text = F.regexp_replace(text, rule.pattern, rule.replacement)
    pairs = F.array(
        *[F.struct(F.lit(rule.name).alias("rule"), F.coalesce(f"h{at}", F.lit(0)).alias("hits")) for at, rule in enumerate(rules)]
    )
    return df.agg(*hits).select(F.inline(pairs))
