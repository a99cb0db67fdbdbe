"""Queries over the locator's scores of blocks and tables from their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import locator as L
from leafline.plans.adapters import LINES, lines
from leafline.registry import register
from leafline.session import table

#: A query for each ten documents: the first three words of an item of the benchmark in capitals, letters only.
_ASKED = """w AS (SELECT item_id, [upper(regexp_replace(split_part(text, ' ', i), '[^A-Za-z]', '', 'g')) FOR i IN [1, 2, 3]] AS w, row_number() OVER (ORDER BY item_id) - 1 AS r, count(*) OVER () AS n FROM benchmark),
  g AS (SELECT DISTINCT doc_id // 10 AS g FROM documents), q AS (SELECT g AS query_id, list_distinct(list_filter(w, lambda x: length(x) >= 3)) AS t FROM g JOIN w ON g % n = r),
  b AS (SELECT doc_id // 10 AS query_id, doc_id AS node_id, doc_id % 10 AS page_no, regexp_replace(lower(split_part(coalesce(text, ''), ' ', 1) || ' ' || source), '[\\s_\\-./\\\\|:,;()\\[\\]{}<>"''`]+', '', 'g') AS title,
    regexp_replace(lower(coalesce(text, '')), '[\\s_\\-./\\\\|:,;()\\[\\]{}<>"''`]+', '', 'g') AS text FROM documents),
  h AS (SELECT query_id, node_id, page_no, len(list_filter(t, lambda x: contains(title, lower(x)))) AS title_hits, len(list_filter(t, lambda x: contains(text, lower(x)))) AS body_hits, len(list_filter(['qu', 'zz'], lambda x: contains(text, x))) AS negative_hits FROM b JOIN q USING (query_id)),
  s AS (SELECT *, least(98, greatest(0, 24 + CASE WHEN query_id % 2 = 0 THEN 6 ELSE -6 END + least(46, 14 * title_hits) + least(40, 9 * body_hits) - least(30, 8 * negative_hits))) AS score FROM h)"""


def asked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id`` and ``seeds`` of a query for each ten documents."""
    from pyspark.sql import Window

    word = lambda i: F.upper(F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(i)), "[^A-Za-z]", ""))
    # the benchmark is a list of items whose number does not grow with the documents
    items = table(spark, sf_dir, "benchmark").select(F.row_number().over(Window.orderBy("item_id")).alias("r"), F.array(word(1), word(2), word(3)).alias("seeds"))
    n = items.count()
    groups = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("query_id")).distinct().withColumn("r", (F.col("query_id") % n + 1).cast("int"))
    return groups.join(items, "r").select("query_id", "seeds")


def asked_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("query_id") % 2 == 0, "text").otherwise("table")
    queries = asked_words(spark, sf_dir).select("query_id", F.col("query_id").alias("doc_id"), F.lit("").alias("slot"), "seeds", F.array(F.lit("QU"), F.lit(" zz")).alias("negatives"), F.array(kind).alias("expected"))
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    nodes = docs.select(F.floor(d / 10).alias("doc_id"), d.alias("node_id"), (d % 10).alias("page_no"), F.lit(1).alias("pages"), F.lit(2).alias("depth"), F.lit("text").alias("kind"), F.concat_ws(" ", F.split_part(text, F.lit(" "), F.lit(1)), "source").alias("title"), text.alias("text"), F.lit(0).alias("rows"), F.lit(0).alias("columns"))
    return L.profiles(queries), nodes


@register("locator_blocks", f"WITH {_ASKED} SELECT query_id, node_id, page_no, CAST(score AS INT) AS score, CAST(title_hits AS INT) AS title_hits, CAST(body_hits AS INT) AS body_hits, CAST(negative_hits AS INT) AS negative_hits FROM s WHERE score > 0")
def locator_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recalled(*asked_blocks(spark, sf_dir)).drop("window_terms", "uncertainties")


@register(
    "locator_rerank",
    f"""WITH {_ASKED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_no, node_id DESC) AS place FROM s WHERE score > 0)
      SELECT query_id, CAST(max(score) AS INT) AS best, max(score) < 86 AND max(score) - coalesce(max(score) FILTER (place = 2), 0) <= 18 AND count(*) > 1 AS rerank, least(count(*), 6) AS candidates FROM r GROUP BY 1""",
)
def locator_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.needs_rerank(L.ranked(L.recalled(*asked_blocks(spark, sf_dir))))


@register(
    "locator_table_windows",
    f"""WITH {LINES}, h AS (SELECT table_id, row_index, flag = 'R' AS r, count(*) OVER (PARTITION BY table_id) AS n FROM lines), k AS (SELECT table_id, row_index, greatest(row_index - 2, 0) AS s, least(row_index + 5, n) AS e, row_index < n - 1 AS f FROM h WHERE r),
      x AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY table_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM k), g AS (SELECT *, sum(fresh) OVER (PARTITION BY table_id ORDER BY row_index) AS g FROM x)
      SELECT table_id AS query_id, min(s) AS start, max(e) AS "end", CASE WHEN bool_or(f) THEN 44 ELSE 32 END AS score FROM g GROUP BY table_id, g""",
)
def locator_table_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around returned lines, whose rows name them; each has three cells, and data follows all but the last."""
    rows = lines(spark, sf_dir).select(F.col("table_id").alias("doc_id"), F.lit(1).alias("node_id"), F.lit(0).alias("table_no"), "row_index", F.array(F.col("line"), F.when(F.col("flag") == "R", "RETURNED").otherwise("kept"), F.col("part")).alias("cells"))
    ids = rows.select("doc_id").distinct()
    queries = ids.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit("").alias("slot"), F.array(F.lit("RETURNED")).alias("seeds"), F.array().cast("array<string>").alias("negatives"), F.array().cast("array<string>").alias("expected"))
    return L.windows(L.profiles(queries), rows).select("query_id", "start", "end", "score")


_ROLES = """WITH RECURSIVE c AS (SELECT p_size AS query_id, p_partkey AS k, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS w, [p_type, p_brand] AS path,
    row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS place FROM part),
  d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k % 20, k) - 1 AS n, place <= 2 AS selected,
    list_filter(list_distinct([lower(regexp_replace(x, '[^0-9A-Za-z_]+', '', 'g')) FOR x IN w]), lambda x: x <> '') AS h FROM c WHERE place <= 12),
  p AS (SELECT o.query_id, o.k, o.n, o.selected, b.n AS bn, len(list_intersect(list_distinct(b.w), list_distinct(o.w))) AS shared, b.path = o.path AS same,
      b.path[1] = o.path[1] AS kin1, b.path[2] = o.path[2] AS kin2, greatest(0, b.k % 20 - o.k % 20 - 1, o.k % 20 - b.k % 20 - 1) AS gap,
      b.k % 4 <> 0 AND o.k % 4 <> 0 AND o.k % 13 <> 0 AS tables, b.k % 3 = 0 AND o.k % 3 = 0 AS named,
      (len(list_intersect(b.h, o.h)) + 0.5 * len(list_filter(b.h, lambda x: NOT list_contains(o.h, x) AND len(list_filter(o.h, lambda y: contains(x, y) OR contains(y, x))) > 0))) / len(b.h) AS alike
    FROM d o LEFT JOIN d b ON b.query_id = o.query_id AND b.n <> o.n),
  m AS (SELECT query_id, k, n, selected, coalesce(bit_or(CASE WHEN tables AND gap <= 1 AND (named AND alike >= 0.45 OR (same OR NOT named) AND shared >= CASE WHEN kin1 OR kin2 THEN 4 ELSE 6 END) THEN 1 << bn ELSE 0 END), 0) AS cont,
      coalesce(bit_or(CASE WHEN shared >= CASE WHEN kin1 OR kin2 OR gap <= 2 THEN 2 ELSE 3 END THEN 1 << bn ELSE 0 END), 0) AS kin FROM p GROUP BY ALL),
  f AS (SELECT query_id, min(n) FILTER (selected) AS pn FROM m GROUP BY 1),
  s AS (SELECT m.*, CASE WHEN n = pn THEN 'primary' WHEN cont & (1 << pn) <> 0 THEN 'continuation' ELSE 'related' END AS role FROM m JOIN f USING (query_id) WHERE selected),
  t AS (SELECT query_id, -1 AS n, NULL::BIGINT AS k, NULL::VARCHAR AS role, bit_or(CASE WHEN role <> 'related' THEN 1 << n ELSE 0 END) AS i, bit_or(CASE WHEN role = 'related' THEN 1 << n ELSE 0 END) AS r FROM s GROUP BY 1
    UNION ALL SELECT query_id, n, k, role, CASE WHEN role = 'continuation' THEN i | (1 << n) ELSE i END, CASE WHEN role = 'related' THEN r | (1 << n) ELSE r END FROM (
      SELECT m.query_id, m.n, m.k, i, r, CASE WHEN m.selected THEN NULL WHEN cont & i <> 0 THEN 'continuation' WHEN kin & (i | r) <> 0 THEN 'related' WHEN m.k % 5 = 0 THEN 'rejected' END AS role FROM t JOIN m ON m.query_id = t.query_id AND m.n = t.n + 1))
  SELECT query_id, k AS node_id, role FROM s UNION ALL SELECT query_id, k, role FROM t WHERE role IS NOT NULL"""


@register("locator_role_closure", _ROLES)
def locator_role_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the best candidates of each size of parts."""
    from pyspark.sql import Window

    k, words = F.col("p_partkey"), F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    place = F.row_number().over(Window.partitionBy("p_size").orderBy(F.desc("p_retailprice"), k))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("query_id"), place.alias("place"), k.alias("node_id"), F.when(k % 4 == 0, "text").otherwise("table").alias("kind"), (k % 20).alias("first"), (k % 20 + 1).alias("last"), F.array("p_type", "p_brand").alias("path"),
        F.when(k % 3 == 0, words).otherwise(F.array().cast("array<string>")).alias("headers"), words.alias("tokens"), (place <= 2).alias("selected"), (k % 5 == 0).alias("rejected"), (k % 13 == 0).alias("blocked"),
    )
    return L.closed_roles(rows)
