"""Cue phrases and field patterns for items of the minutes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F


class Cue(NamedTuple):
    kind: str
    lang: str
    pattern: str


# Cue phrases by kind and language, matched as whole words in lower case.
CUES = [
    Cue("action", "en", "action item|to do|todo|will|shall|needs? to|follow up|take care of"),
    Cue("action", "de", "aufgabe|muss|müssen|wird|kümmert sich"),
    Cue("action", "fr", "à faire|doit|devra|se charge de"),
    Cue("action", "es", "pendiente|debe|deberá|se encarga de"),
    Cue("decision", "en", "decided|agreed|approved|resolved|decision"),
    Cue("decision", "de", "beschlossen|entschieden|vereinbart|beschluss"),
    Cue("decision", "fr", "décidé|convenu|approuvé|décision"),
    Cue("decision", "es", "decidido|acordado|aprobado|decisión"),
    Cue("question", "en", "who|what|when|where|why|how|open question"),
    Cue("question", "de", "wer|was|wann|warum|wie|offene frage"),
    Cue("question", "fr", "qui|quand|pourquoi|comment|question ouverte"),
    Cue("question", "es", "quién|cuándo|por qué|cómo|pregunta abierta"),
    Cue("done", "en", "done|completed|finished|closed"),
    Cue("done", "de", "erledigt|abgeschlossen|fertig"),
    Cue("done", "fr", "terminé|achevé|clos"),
    Cue("done", "es", "hecho|terminado|cerrado"),
]

# Where a sentence names its owner and its due date.
OWNER_PATTERN = r"(?:[Oo]wner|[Aa]ssigned to|[Aa]ction for)[: ]+(\p{L}+)"
DOER_PATTERN = r"^(\p{L}+) (?:will|shall|needs to|is to) "
# Doers that name nobody by themselves.
FIRST_PERSON = ["i"]
PRONOUNS = ["we", "you", "he", "she", "it", "they", "this", "that", "these", "those", "there", "who", "what", "which", "everybody", "somebody", "nobody"]
DUE_PATTERN = r"(?:by|until|before|due) (\d{4}-\d{2}-\d{2})"
DATE_FORMAT = "yyyy-MM-dd"

LISTED_CUES = 10_000
OPTIONAL_LETTERS = 4


def lexicon_from(table: DataFrame, limit: int = LISTED_CUES) -> list[Cue]:
    """Cues of a table as a list, for those who want one pattern per kind; not for a table of more than
    `limit`. `items.cue_items` takes a table of any size as it is."""
    rows = table.select("kind", "lang", "pattern").orderBy("kind", "lang", "pattern").take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} cues")
    return [Cue(*row) for row in rows]


def phrases(table: DataFrame) -> DataFrame:
    """(kind, lang, phrase, words) for a table of cues (kind, lang, pattern): a pattern is phrases between `|`, and a
    letter before `?` may be missing, at most four times in a phrase. Phrases without a letter find nothing."""
    cut = table.select("kind", "lang", F.explode(F.split("pattern", r"\|")).alias("phrase"))
    for _ in range(OPTIONAL_LETTERS):
        both = F.array(F.regexp_replace("phrase", r"^([^?]*)\?", "$1"), F.regexp_replace("phrase", r"^([^?]*)[^?]\?", "$1"))
        cut = cut.select("kind", "lang", F.explode(F.array_distinct(both)).alias("phrase"))
    words = F.array_distinct(F.array_remove(F.split("phrase", r"[^\p{L}]+"), ""))
    return cut.distinct().withColumn("words", words).filter(F.size("words") > 0)


def holds_phrase(sentence: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the sentence with no letter before or after it."""
    return F.rlike(F.lower(sentence), F.concat(F.lit(r"(^|[^\p{L}])\Q"), phrase, F.lit(r"\E([^\p{L}]|$)")))


def patterns(lexicon: list[Cue]) -> dict[tuple[str, str], str]:
    """One whole-word pattern per kind and language, in order."""
    found: dict[tuple[str, str], list[str]] = {}
    for cue in lexicon:
        found.setdefault((cue.kind, cue.lang), []).append(cue.pattern)
    return {key: _whole_words(found[key]) for key in sorted(found)}


def _whole_words(found: list[str]) -> str:
    return r"(^|[^\p{L}])(" + "|".join(found) + r")([^\p{L}]|$)"


def kinds_of(sentence: Column, lexicon: list[Cue], lang: Column) -> Column:
    """The kinds whose cues in the language `lang` occur in a sentence, as an array. One pattern of all cues of
    a language comes first, as most sentences have none; only the others are tested kind by kind."""
    lowered = F.lower(sentence)
    found: dict[str, list[Column]] = {}
    for (kind, own), pattern in patterns(lexicon).items():
        found.setdefault(own, []).append(F.when(lowered.rlike(pattern), F.lit(kind)).otherwise(F.lit("")))
    kinds = [
        F.when((lang == own) & lowered.rlike(_whole_words([cue.pattern for cue in lexicon if cue.lang == own])), F.array_remove(F.array(*hits), ""))
        for own, hits in found.items()
    ]
    return F.coalesce(*kinds, F.array().cast("array<string>"))


def _nullif_blank(value: Column) -> Column:
    return F.when(value != "", value)


def owner_of(sentence: Column, speaker: Column) -> Column:
    """Who is named as owner, or as the doer; the speaker of a sentence in the first person;
    nobody if another pronoun is the doer."""
    named = _nullif_blank(F.regexp_extract(sentence, OWNER_PATTERN, 1))
    doing = _nullif_blank(F.regexp_extract(sentence, DOER_PATTERN, 1))
    doer = F.when(F.lower(doing).isin(FIRST_PERSON), speaker).when(~F.lower(doing).isin(PRONOUNS), doing)
    return F.coalesce(named, doer)


def due_of(sentence: Column) -> Column:
    return F.try_to_date(_nullif_blank(F.regexp_extract(sentence, DUE_PATTERN, 1)), DATE_FORMAT)
