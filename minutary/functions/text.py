"""Splitting text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SENTENCE_BREAK = r"[.!?]+\s*|\n+"
WORD_BREAK = r"[^\p{L}]+"


def sentence_list(text: Column) -> Column:
    pieces = F.transform(F.split(text, SENTENCE_BREAK), lambda piece: F.trim(piece))
    return F.filter(pieces, lambda piece: piece != "")


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters, in order."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def phrase_list(words: Column, n: int) -> Column:
    """Runs of `n` neighbouring words. `words` should be a column of its own, as it is
    read n times here."""
    starts = F.greatest(F.size(words) - n + 1, F.lit(0))
    phrases = F.slice(words, 1, starts) if n > 1 else words
    for ahead in range(1, n):
        phrases = F.zip_with(
            phrases, F.slice(words, 1 + ahead, starts), lambda so_far, word: F.concat(so_far, F.lit(" "), word)
        )
    return phrases


def rounded(value: Column, places: int = 6) -> Column:
    """Rounded for output and ranking; adding 0.0 turns -0.0 into 0.0."""
    return F.round(value, places) + F.lit(0.0)
