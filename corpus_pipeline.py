"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's documents. All stages take
rows with nulls in any column, empty and very long texts and further columns,
which go; an empty table gives an empty result. What else a stage does with such
rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import credentials, langid, minhash, mixing, packing
from leafline.llm.runtime import Tables
from leafline.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, however close the others come.

    Those without a letter go, null and empty texts among them, and all where no
    language was learned. Repeated rows stay repeated; ties don't matter.
    """
    model = langid.train(docs.where(~langid.held_out("doc_id")), "doc_id", "text", "lang")
    found = langid.identify(docs, model)
    return found.where(F.col("lang_pred") != "und").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on five-word shingles: that of the smallest id.

    Rows that repeat an id become one; rows without an id stay. Texts without
    words are nobody's copy.
    """
    return minhash.keep_first(docs, size=5, percent=80).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of every secret; ``n_chars`` counts what is left, null for a null text."""
    return credentials.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target weights of clean, low and toxic text.

    Rows alike in id and text stay or go together, rows without an id each by
    its text. Without labels all stay.
    """
    return mixing.sample_mixture(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; null and empty texts are an end token each, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but the third and the last could be put in SQL, so tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    for _, stage in STAGES:
        docs, before = tables.put(stage(spark, docs, sf_dir)), docs
        tables.drop(before)
    return docs
