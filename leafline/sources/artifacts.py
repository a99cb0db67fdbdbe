"""Content lists in, artifacts and tables out."""

from __future__ import annotations

import posixpath
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<type:string,text:string,text_level:int,page_idx:int,img_caption:array<string>,table_body:string>"


def content_blocks(documents: DataFrame, id_col: str = "doc_id", json_col: str = "content") -> DataFrame:
    """Blocks of OCR content lists, of either form, in reading order.

    A flat list carries its page in each item (0 if missing); in a nested list
    the place of a page's list is its page. Returns ``doc_id, page_no`` (from 1),
    ``ord`` (from 1 over the document), ``kind, level, text, html``. Items with
    neither text nor table are left out.
    """
    raw = F.col(json_col)
    nested = raw.rlike(r"^\s*\[\s*\[")
    flat = F.transform(F.from_json(F.when(~nested, raw), f"array<{ITEM}>"), lambda x, i: F.struct(F.coalesce(x["page_idx"], F.lit(0)).alias("page"), i.alias("i"), x.alias("x")))
    paged = F.flatten(F.transform(F.from_json(F.when(nested, raw), f"array<array<{ITEM}>>"), lambda page, p: F.transform(page, lambda x, i: F.struct(p.alias("page"), i.alias("i"), x.alias("x")))))
    items = F.filter(F.array_sort(F.coalesce(flat, paged)), lambda b: (F.coalesce(b["x"]["text"], F.lit("")) != "") | (F.coalesce(b["x"]["table_body"], F.lit("")) != ""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(items).alias("o", "b"))
    x = F.col("b.x")
    kind = F.when((x["type"] == "text") & (F.coalesce(x["text_level"], F.lit(0)) > 0), "title").when(x["type"].isin("text", "paragraph"), "text").otherwise(x["type"])
    return rows.select("doc_id", (F.col("b.page") + 1).alias("page_no"), (F.col("o") + 1).alias("ord"), kind.alias("kind"), F.coalesce(x["text_level"], F.lit(1)).alias("level"), F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["table_body"], F.lit("")).alias("html"))


def object_key(*parts: Column) -> Column:
    """A key below a root: parts joined, so that none can step out of it."""
    return F.array_join(F.filter(F.array(*[F.regexp_replace(p, r"[^0-9A-Za-z._\-]+", "_") for p in parts]), lambda p: ~p.isin("", ".", "..")), "/")


def artifacts(rows: DataFrame, id_col: str, kind: str, columns: list[str]) -> DataFrame:
    """A JSON artifact of each row with its SHA-256, size and key."""
    body = F.to_json(F.struct(*columns))
    return rows.select(F.col(id_col).alias("id"), body.alias("body"), F.sha2(body, 256).alias("content_hash"), F.octet_length(body).cast("long").alias("size_bytes"), F.concat(object_key(F.lit(kind), F.col(id_col).cast("string")), F.lit(".json")).alias("object_key"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with rows of the same key replaced by those of ``changes``, the others added."""
    rest = base.join(changes.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(changes)


def replace_scope(base: DataFrame, rows: DataFrame, scope: list[str]) -> DataFrame:
    """``base`` without anything of the scopes in ``rows``, and with ``rows``."""
    return upsert(base, rows, scope)


def snapshot_path(root: str, name: str) -> str:
    """Where a named snapshot lies; names that leave the root are refused."""
    path = posixpath.normpath(posixpath.join(root, name))
    if not path.startswith(posixpath.normpath(root).rstrip("/") + "/"):
        raise ValueError(f"{name} lies outside {root}")
    return path


def write_snapshot(rows: DataFrame, root: str, name: str) -> str:
    """Write rows as a Parquet snapshot; a reader sees all of it or none."""
    path = snapshot_path(root, name)
    rows.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(snapshot_path(root, name))


class Recognizer(Protocol):
    """An outside service that turns files into content lists."""

    def recognize(self, files: DataFrame) -> DataFrame: ...


class Completer(Protocol):
    """An outside language model, asked one prompt a row."""

    def complete(self, prompts: DataFrame) -> DataFrame: ...


class EchoCompleter:
    """Answers offline and the same each time: the prompt's ``label: value`` lines as JSON."""

    def complete(self, prompts: DataFrame) -> DataFrame:
        lines = F.filter(F.split("prompt", "\n"), lambda x: x.rlike(r"^[^:]{1,40}:\s*\S"))
        pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
        return prompts.withColumn("answer", F.to_json(pairs))
