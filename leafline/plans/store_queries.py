"""Queries over confirmed hints, stored artifacts and trees of raw content lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.registry import register
from leafline.session import table
from leafline.sources import store, versions
from leafline.sources.artifacts import artifacts
from leafline.streaming import hints


@register(
    "hint_profiles",
    """WITH h AS (SELECT DISTINCT 'p' || (user_id % 40) AS profile_id, 'h' || (event_id % 500) AS hint_id, ts AS seen, [event_type, 'w' || (event_id % 90), 'é' || (event_id % 3)] AS terms FROM events),
      o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY profile_id, hint_id ORDER BY seen DESC) = 1), k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY seen DESC, hint_id DESC) <= 8),
      t AS (SELECT profile_id, seen, hint_id, unnest(terms) AS term, unnest(generate_series(1, 3)) AS i FROM k), u AS (SELECT profile_id, term, min(row(seen, hint_id, i)) AS o FROM t WHERE NOT regexp_matches(term, '^[a-z0-9]{1,2}$') GROUP BY 1, 2)
      SELECT k.profile_id, string_agg(hint_id, ',' ORDER BY seen, hint_id) AS hints, (SELECT string_agg(term, ',' ORDER BY o) FROM u WHERE u.profile_id = k.profile_id) AS terms FROM k GROUP BY 1""",
)
def hint_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hints of forty profiles, ids used again and again."""
    e = F.col("event_id")
    text = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    confirmed = table(spark, sf_dir, "events").select(text("p", F.col("user_id") % 40).alias("profile_id"), text("h", e % 500).alias("hint_id"), F.col("ts").alias("at"), F.array("event_type", text("w", e % 90), text("é", e % 3)).alias("terms"))
    return hints.profiles(confirmed).select("profile_id", F.array_join("hint_ids", ",").alias("hints"), F.array_join("terms", ",").alias("terms"))


@register(
    "artifact_fetch",
    """SELECT event_id, CASE WHEN k IS NULL OR user_id % 3 = 2 OR k % 7 = 3 OR k % 7 = 4 THEN NULL ELSE status END AS status, CASE WHEN k IS NULL THEN 'missing' WHEN user_id % 3 = 2 THEN 'changed' WHEN k % 7 IN (3, 4) THEN 'broken' END AS fault
      FROM events LEFT JOIN (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0) ON k = event_id""",
)
def artifact_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts, some cut short, some not what their hash says, asked for by events; every third user asks for contents that never were there."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 5 != 0)
    kept = artifacts(orders, "o_orderkey", "order", ["o_orderkey", "o_orderstatus"]).withColumn("kind", F.lit("order"))
    body = F.when(F.col("id") % 7 == 3, F.substring("body", 1, 9)).otherwise(F.col("body"))
    wrong = kept.withColumn("body", body).withColumn("content_hash", F.when(F.col("id") % 7 == 3, F.sha2("body", 256)).when(F.col("id") % 7 == 4, "0").otherwise(F.col("content_hash")))
    stored = wrong.select("kind", store.shard(F.col("id")).alias("shard"), F.col("id").cast("string").alias("id"), "body", "content_hash")
    wanted = table(spark, sf_dir, "events").select("event_id", F.lit("order").alias("kind"), F.col("event_id").alias("id"), F.when(F.col("user_id") % 3 == 2, "other").alias("content_hash"))
    return store.fetched(wanted, stored).select("event_id", F.get_json_object("body", "$.o_orderstatus").alias("status"), "fault")


_RAW = """r AS (SELECT doc_id, CASE doc_id % 8 WHEN 5 THEN 'no_json' WHEN 6 THEN 'no_list' WHEN 7 THEN 'missing' WHEN 4 THEN 'empty' END AS error, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents)"""


def raw_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content list a document: two headings with the source between them and the text behind; of eight documents four are broken, another shape, missing or empty."""
    d = F.col("doc_id")
    item = lambda text, level: F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(level).alias("text_level"), (d % 3).alias("page_idx"))
    whole = F.to_json(F.array(item(F.lit("1 A"), 1), item(F.col("source"), 0), item(F.lit("1.1 B"), 2), item(F.col("text"), 0)))
    content = F.when(d % 8 == 4, "[]").when(d % 8 == 5, F.substring(whole, 1, 20)).when(d % 8 == 6, '{"a": 1}').when(d % 8 != 7, whole)
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


@register(
    "tree_status",
    f"WITH {_RAW} SELECT doc_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'error' END AS status, error, CAST(CASE WHEN error IS NULL THEN 2 + CAST(text <> '' AS INT) + CAST(source <> '' AS INT) ELSE 0 END AS BIGINT) AS blocks, CAST(CASE WHEN error IS NULL THEN 2 ELSE 0 END AS BIGINT) AS headings FROM r",
)
def tree_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.tree_tables(raw_content(spark, sf_dir))["status"]


@register(
    "tree_nodes",
    f"WITH {_RAW}, k AS (SELECT doc_id, doc_id % 3 + 1 AS page_no, 2 + CAST(source <> '' AS INT) AS second FROM r WHERE error IS NULL) SELECT doc_id, 'n1' AS node_id, NULL AS parent_id, page_no FROM k UNION ALL SELECT doc_id, 'n' || second, 'n1', page_no FROM k",
)
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.tree_tables(raw_content(spark, sf_dir))["nodes"].select("doc_id", "node_id", "parent_id", F.col("page_no").cast("bigint").alias("page_no"))
