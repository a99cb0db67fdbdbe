"""Sets of tables that are read as one: a document tree's nodes, modules, steps and status, committed by a manifest written last.

Each version's tables lie in a folder of their own that nothing points to until
its manifest is there. A manifest is one row in one file, which Spark's commit
moves into place at once: a reader sees the whole old or the whole new version,
and what a writer left that stopped between tables is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafline.operators import tree as T
from leafline.sources.artifacts import content_blocks

_MANIFEST = "version long, folder string, tables map<string,string>"


class NoVersion(LookupError):
    """Nothing was committed, or not that version or table."""


class Conflict(RuntimeError):
    """Two writers committed the same version; the one of the smaller folder name holds."""


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """What was committed below ``root``: ``version, folder, tables`` (name to schema)."""
    try:
        return spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").json(f"{root}/manifests").where("folder is not null")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _MANIFEST)
        raise


def _chosen(spark: SparkSession, root: str, version: int | None) -> tuple[int, str, dict[str, str]] | None:
    """A version's manifest, the last one's if none is named: one row reaches the driver."""
    held = manifests(spark, root)
    asked = held if version is None else held.where(F.col("version") == version)
    row = asked.orderBy(F.desc("version"), "folder").first()
    return row and (row["version"], row["folder"], row["tables"])


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write ``tables`` as the next version and return its number.

    A version is only there once all of its tables are. If another writer took the
    same number meanwhile, one of both is told so by ``Conflict``. Versions before
    stay readable until their folder is deleted.
    """
    last = _chosen(spark, root, None)
    version = last[0] + 1 if last else 1
    folder = f"data/{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{root}/{folder}/{name}")
    row = spark.createDataFrame([(version, folder, {name: rows.schema.json() for name, rows in tables.items()})], _MANIFEST)
    row.coalesce(1).write.mode("errorifexists").json(f"{root}/manifests/{folder.rsplit('/', 1)[1]}")
    held = _chosen(spark, root, version)
    if held is None or held[1] != folder:
        raise Conflict(f"version {version} below {root} was committed by another writer")
    return version


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version, by default of the last."""
    held = _chosen(spark, root, version)
    if held is None or name not in held[2]:
        raise NoVersion(f"{name} of version {version or 'last'} below {root}")
    return spark.read.schema(StructType.fromJson(json.loads(held[2][name]))).parquet(f"{root}/{held[1]}/{name}")


def tree_tables(documents: DataFrame, id_col: str = "doc_id", json_col: str = "content") -> dict[str, DataFrame]:
    """The tables of documents' trees from their raw content lists, a ``status`` row for every document.

    ``status`` is ``completed`` with the number of its headings, or ``error`` with
    what is wrong: ``missing``, ``no_json``, ``no_list`` or ``empty``. Documents in
    error have no rows in ``nodes`` and ``modules``.
    """
    v = F.try_parse_json(json_col)
    kind = F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    wrong = F.when(F.coalesce(F.trim(json_col), F.lit("")) == "", "missing").when(v.isNull(), "no_json").when(kind != "ARRAY", "no_list")
    held = documents.select(F.col(id_col).alias("doc_id"), F.col(json_col).alias("content"), wrong.alias("error"))
    blocks = content_blocks(held.where("error is null"), "doc_id", "content")
    titles = blocks.where("kind = 'title'").select("doc_id", "ord", F.concat(F.lit("n"), F.col("ord").cast("string")).alias("node_id"), F.col("text").alias("title"), "level", "page_no")
    nodes = T.nested(titles)
    counts = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum((F.col("kind") == "title").cast("long")).alias("headings"))
    told = held.select("doc_id", "error").join(counts, "doc_id", "left")
    error = F.coalesce("error", F.when(F.col("blocks").isNull(), "empty"))
    status = told.select("doc_id", F.when(error.isNull(), "completed").otherwise("error").alias("status"), error.alias("error"), F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"), F.coalesce("headings", F.lit(0).cast("long")).alias("headings"))
    return {"nodes": nodes, "modules": T.modules(titles), "status": status}
