"""From raw documents to token ids: language, repeated lines, near copies, leaks, tokens.

Each stage takes what the one before it kept, as written and read again, works on all of it, and all
but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from minutary.llm import bpe, decontaminate, langid, lines, simhash
from minutary.session import work_dir

TOKENIZER = "byte_bpe_50k.json"
# Spans, shares of letters and the like have no form in SQL; tested by brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or without text, go. The model is learned from the
    three quarters of labelled rows that crc32 of the id names. If these teach no language, none can
    be told, and a text stays if it has a letter."""
    model = langid.learn(docs.filter(langid.remainder("doc_id", 4) != 2))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    named = langid.identify(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN)
    return _columns(named, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; n_chars follows where a text changed."""
    left = lines.drop_repeated_lines(docs).withColumn("text", F.col("text").cast("string"))
    found = _columns(left, docs, {"n_chars": F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("rest.n_chars"))})
    return found


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of `benchmark` go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of the text that they decode to."""
    coded = bpe.encode_texts(docs, public_tokenizers.path(TOKENIZER))
    return coded.select("rest.doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", tokens),
]


def _columns(packed: DataFrame, docs: DataFrame, changed: dict | None = None) -> DataFrame:
    """The columns of `docs`, in order and type, from (rest, text)."""
    changed = changed or {}
    picked = []
    for field in docs.schema.fields:
        own = F.col("text") if field.name == "text" else changed.get(field.name, F.col("rest").getField(field.name))
        picked.append(own.cast(field.dataType).alias(field.name))
    return packed.select(*picked)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = work_dir(spark, name)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
