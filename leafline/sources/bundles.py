"""Bundles and files that a document is delivered in, and stores of states, logs and trees."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of a bundle by what they hold, the first that fits counts.
MEMBERS = (
    ("markdown", r"(^|/)full\.md$"),
    ("content_list", r"(^|/)content_list_v2\.json$"),
    ("content_list", r"content_list\.json$"),
    ("layout", r"(^|/)(layout|middle)\.json$"),
    ("blocks", r"(^|/)block_list\.json$"),
    ("model", r"(^|/)model\.json$"),
)


def member_kind(name: Column) -> Column:
    kind = F.lit(None).cast("string")
    for held, pattern in reversed(MEMBERS):
        kind = F.when(name.rlike(pattern), held).otherwise(kind)
    return kind


def bundle_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of zip bundles below ``path``: ``bundle, member, kind, text``; broken bundles and other members are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    bundle = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for member in bundle.namelist():
                    if member.endswith((".md", ".json")):
                        text = bundle.read(member).decode("utf-8", "replace")
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([text])], ["bundle", "member", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    found = files.mapInArrow(read, "bundle string, member string, text string")
    return found.withColumn("kind", member_kind(F.col("member"))).where("kind is not null").select("bundle", "member", "kind", "text")


def chosen_members(members: DataFrame) -> DataFrame:
    """One member of each kind a bundle: the newer content list before the older, then the first by name."""
    order = F.when(F.col("member").rlike(r"content_list_v2\.json$"), 0).otherwise(1)
    best = F.min(F.struct(order.alias("o"), "member", "text")).alias("b")
    return members.groupBy("bundle", "kind").agg(best).select("bundle", "kind", F.col("b.member").alias("member"), F.col("b.text").alias("text"))


def write_states(rows: DataFrame, path: str, by: str) -> None:
    """Records as JSON lines, a folder for each value of ``by``; a state written again takes the place of those of its values only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def read_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """States as they were written; a line that is no record of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_tree(nodes: DataFrame, modules: DataFrame, steps: DataFrame, path: str) -> None:
    """A document tree's nodes, text, modules and steps side by side below ``path``."""
    for name, rows in (("nodes", nodes), ("modules", modules), ("steps", steps)):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def read_tree(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """What ``write_tree`` wrote, by name."""
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def segments(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pasted samples as facts in order: tables that stand in a text, and the paragraphs between them.

    Returns ``id, ord, kind`` (table or text) and ``text``; blank paragraphs go.
    """
    cut = F.regexp_replace(text_col, r"(?is)(<table[\s\S]*?</table>)", "\n\n$1\n\n")
    parts = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(cut, r"\n\s*\n")).alias("ord", "text")).withColumn("text", F.trim("text")).where("text <> ''")
    return parts.select("id", "ord", F.when(F.col("text").rlike("(?i)^<table"), "table").otherwise("text").alias("kind"), "text")
