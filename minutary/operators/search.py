"""Finding turns by words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from minutary.functions import text as tx

# The usual BM25 parameters.
K1 = 1.2
B = 0.75

# Words of a query, cut as `text.WORD_BREAK` cuts those of turns: "e-mail" is two.
_LETTERS = re.compile(r"[^\W\d_]+")


def _uses(words: str, wanted: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, wanted))


def asked_words(query: str | list[str]) -> list[str]:
    """The different words of a query."""
    phrases = [query] if isinstance(query, str) else query
    asked = sorted({word for phrase in phrases for word in _LETTERS.findall(phrase.lower())})
    if not asked:
        raise ValueError("nothing to search for")
    return asked


def search_turns(turns: DataFrame, query: str | list[str], k: int) -> DataFrame:
    """The k turns that match best by BM25, ties by key. Words are runs of letters.

    The corpus figures are one row of sums. Turns without any of the words are passed
    over by a pattern before they are split. Nothing is shuffled but those sums and k
    rows per task.
    """
    asked = asked_words(query)
    words = turns.select(tx.word_list(F.col("text")).alias("_words"))
    figures = words.agg(
        F.struct(
            F.count(F.lit(1)).alias("turns"),
            F.avg(F.size("_words")).alias("mean_words"),
            *[F.count_if(F.array_contains("_words", word)).alias(f"with{at}") for at, word in enumerate(asked)],
        ).alias("figures")
    ).scalar()
    some = r"(^|[^\p{L}])(" + "|".join(asked) + r")([^\p{L}]|$)"
    found = turns.filter(F.lower("text").rlike(some))
    split = found.select("meeting_id", "turn", tx.word_list(F.col("text")).alias("_words"))
    uses = [_uses("_words", word).alias(f"_tf{at}") for at, word in enumerate(asked)]
    rows = split.select("meeting_id", "turn", F.size("_words").alias("_words"), *uses).withColumn("_f", figures)
    score = F.lit(0.0)
    for at in range(len(asked)):
        with_word = F.col(f"_f.with{at}")
        rarity = F.ln((F.col("_f.turns") - with_word + 0.5) / (with_word + 0.5) + 1)
        uses = F.col(f"_tf{at}")
        length = 1 - B + B * F.col("_words") / F.col("_f.mean_words")
        score = score + rarity * uses * (K1 + 1) / (uses + K1 * length)
    return (
        rows.select("meeting_id", "turn", tx.rounded(score).alias("score"))
        .orderBy(F.desc("score"), "meeting_id", "turn")
        .limit(k)
    )
