"""A corpus's way from raw documents to token ids. Each stage works on what the one before it kept, written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundhouse.llm import jaccard, langid, mixing, pieces, secrets
from roundhouse.llm.common import numbered, table, written

#: A text of which a smaller share of n-grams is of any learnt language is in none of them.
LEAST_KNOWN = 0.2
MODEL = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them have; without any labelled, all.

    What goes: null texts and those without a letter, and texts of which less than LEAST_KNOWN of the n-grams are of the language
    that fits best. Repeated rows, null keys and all columns stay as they are.
    """
    filters = langid.fit(docs)
    if not filters.langs:
        return docs
    plain, named = numbered(docs, "text")
    found = langid.predict(plain, filters)
    return named(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_KNOWN)).select(*plain.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id; documents without words all stay."""
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret, and n_chars of the text as it is then."""
    plain, named = numbered(docs, "text")
    clean = named(secrets.redact(plain))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, once or several times, as equal rows. Null texts have no words, and come as often as the rate of their source says."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the original byte span of each, empty for null and empty texts; of the other columns doc_id and source are left."""
    found = pieces.encode(docs.select("doc_id", "source", "text"), pieces.model_bytes(public_tokenizers.path(MODEL)), keep_text=False)
    return found.select("doc_id", "source", "piece_ids", "piece_begins", "piece_ends", F.size("piece_ids").cast("long").alias("n_tokens"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("encode", encode)]

#: SQL can't express the language filters, the guess cost and the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else written(docs), sf_dir)
    return docs
