"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import chat, collisions, credentials, crosspolytope, importance, langid, minhash, mixing, packing, passages, periods, quality, wrappers
from leafline.session import table


def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets reach a similarity of 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op1_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024)


def op3_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of vectors at a cosine of 0.9."""
    return collisions.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), limit=0.9)


def op4_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each whose id 100 divides."""
    rows = table(spark, sf_dir, "embeddings")
    return crosspolytope.search(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels not held out."""
    return quality.predict_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's side."""
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op8_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows not held out."""
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op9_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with linked weak parts."""
    return credentials.scan(table(spark, sf_dir, "documents"))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of every document in a mixture of clean, low and toxic text."""
    return mixing.mix_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_ngram_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents most like the benchmark's texts, one in twenty."""
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5)
    return found.withColumnRenamed("id", "doc_id")


def op12_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of an earlier one."""
    found = passages.repeated_passages(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, one in ten with a repeat planted by rule."""
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), edit=periods.planted)
    found = found.withColumn("best", periods.strongest(F.col("runs")))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = {
    "op1_best_two_fit": op1_best_two_fit,
    "op2_circulant_minhash": op2_circulant_minhash,
    "op3_collision_counting": op3_collision_counting,
    "op4_wrapper_extraction": op4_wrapper_extraction,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_ftrl_quality": op6_ftrl_quality,
    "op7_perspective_rotation": op7_perspective_rotation,
    "op8_cross_parsing_language": op8_cross_parsing_language,
    "op9_credential_linking": op9_credential_linking,
    "op10_soft_mixing": op10_soft_mixing,
    "op11_ngram_importance": op11_ngram_importance,
    "op12_run_length_index": op12_run_length_index,
    "op13_suffix_tree_runs": op13_suffix_tree_runs,
    "pipeline": pipeline,
}

_ORACLES = {"op7_perspective_rotation": chat.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
