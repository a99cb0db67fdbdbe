"""Queries over what was located in document trees: scopes, their summaries, source texts and row budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import source_text as S
from leafline.registry import register
from leafline.session import table

#: Twenty documents a tree: each fifth is at the top, the others lie one or two levels below it.
_TREES = r"""h AS (SELECT doc_id // 20 AS g, doc_id AS ord, 'd' || doc_id AS node_id, CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 3 END AS level, coalesce(source, '') || ' ' || doc_id AS title, lang, text FROM documents),
  e AS (SELECT h.*, (SELECT min(o.ord) FROM h o WHERE o.g = h.g AND o.ord > h.ord AND o.level <= h.level) AS end_ord FROM h),
  c AS (SELECT e.*, g AS query_id FROM e WHERE ord % 20 IN (5, 6, 13, 15)),
  s AS (SELECT DISTINCT c.g AS query_id, h.*, h.ord % 20 IN (5, 6, 13, 15) AS own FROM c JOIN h ON h.g = c.g AND h.ord >= c.ord AND (c.end_ord IS NULL OR h.ord < c.end_ord))"""


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    level = F.when(d % 5 == 0, 1).when((d % 5).isin(1, 3), 2).otherwise(3)
    return table(spark, sf_dir, "documents").select(F.floor(d / 20).alias("doc_id"), d.alias("ord"), F.concat(F.lit("d"), d.cast("string")).alias("node_id"), level.alias("level"), F.concat(F.coalesce("source", F.lit("")), F.lit(" "), d.cast("string")).alias("title"))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four nodes a tree, one of them below another, and every third time one that is not there."""
    held = trees(spark, sf_dir)
    found = held.where((F.col("ord") % 20).isin(5, 6, 13, 15)).select(F.col("doc_id").alias("query_id"), "doc_id", "node_id")
    return found.unionByName(found.where("doc_id % 3 = 0").select("query_id", "doc_id", F.lit("gone").alias("node_id")).distinct())


def module_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module a document: its text, and for every third a table."""
    d = F.col("doc_id")
    pages = F.array((d % 20).cast("int"))
    texts = F.array(F.struct(pages.alias("pages"), F.col("text").alias("content"), F.lit("").alias("title")))
    grid = F.struct(F.array().cast("array<int>").alias("pages"), F.col("lang").alias("title"), F.concat(F.lit("| "), d.cast("string"), F.lit(" |")).alias("markdown"))
    tables = F.when(d % 3 == 0, F.array(grid))
    title = F.concat(F.coalesce("source", F.lit("")), F.lit(" "), d.cast("string"))
    text = S.skill_input(title, F.array(F.lit("root"), title), texts, tables)
    return table(spark, sf_dir, "documents").select(F.floor(d / 20).alias("doc_id"), F.concat(F.lit("d"), d.cast("string")).alias("node_id"), title.alias("title"), text.alias("input"))


_INPUT = r"""regexp_replace('模块：' || title || chr(10) || '路径：root / ' || title || chr(10) || chr(10) || '## 文本' || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || '- 第 ' || (ord % 20) || ' 页：' || text ELSE '' END
  || CASE WHEN ord % 3 = 0 THEN chr(10) || chr(10) || '## 表格' || chr(10) || chr(10) || '### ' || coalesce(nullif(lang, ''), '表格 1') || '（第 - 页）' || chr(10) || '| ' || ord || ' |' ELSE '' END, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"""

_PARTS = rf"""{_TREES}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n, regexp_replace(title, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS name, {_INPUT} AS x FROM s),
  p AS (SELECT *, '## 命中模块 ' || n || '：' || name || chr(10) || CASE WHEN length(x) > 2200 THEN left(x, 2200) || '{S.MODULE_CUT.replace(chr(10), "' || chr(10) || '")}' ELSE x END AS part FROM i),
  b AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
  t AS (SELECT query_id, count(*) AS modules, regexp_replace(string_agg(CASE WHEN length(part) > 16000 - before THEN left(part, CAST(16000 - before AS INT)) || '{S.SOURCE_CUT.replace(chr(10), "' || chr(10) || '")}' ELSE part END, chr(10) || chr(10) ORDER BY n) FILTER (before < 16000), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS source_text FROM b GROUP BY 1)"""


@register("scope_rows", f"WITH {_TREES} SELECT query_id, node_id, CASE WHEN own THEN 'selected_node' ELSE 'descendant' END AS reason FROM s")
def scope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scope_rows(S.placed(trees(spark, sf_dir)), chosen(spark, sf_dir)).select("query_id", "node_id", "reason")


@register(
    "scope_summary",
    f"""WITH {_TREES}, g AS (SELECT query_id, count(*) AS modules, CAST(count(*) FILTER (NOT own) AS BIGINT) AS descendants FROM s GROUP BY 1),
      pg AS (SELECT DISTINCT query_id, unnest(generate_series(ord % 20 // 3, ord % 20 // 3 + CASE WHEN ord % 7 = 0 THEN 1 ELSE 0 END)) AS page FROM s WHERE ord % 11 <> 0), pi AS (SELECT query_id, page, page - row_number() OVER (PARTITION BY query_id ORDER BY page) AS k FROM pg),
      pj AS (SELECT query_id, min(page) || '-' || max(page) AS r, min(page) AS a FROM pi GROUP BY query_id, k), pk AS (SELECT query_id, string_agg(r, ',' ORDER BY a) AS pages FROM pj GROUP BY 1),
      bl AS (SELECT query_id, count(DISTINCT b) AS blocks FROM (SELECT query_id, unnest(generate_series(ord * 10, ord * 10 + ord % 13)) AS b FROM s) GROUP BY 1),
      en AS (SELECT query_id, string_agg('d' || end_ord, ',' ORDER BY end_ord) AS boundaries FROM (SELECT DISTINCT query_id, end_ord FROM c WHERE end_ord IS NOT NULL) GROUP BY 1)
      SELECT query_id, modules, descendants, coalesce(pages, '') AS pages, blocks, coalesce(boundaries, '') AS boundaries, CAST(CASE WHEN query_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS missing FROM g LEFT JOIN pk USING (query_id) LEFT JOIN bl USING (query_id) LEFT JOIN en USING (query_id)""",
)
def scope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes lie on a page or two, some on none, with up to thirteen blocks that run into the next node's."""
    o = F.col("ord")
    page = F.when(o % 11 != 0, F.floor(o % 20 / 3))
    places = S.placed(trees(spark, sf_dir)).withColumns({"first_page": page, "last_page": page + F.when(o % 7 == 0, 1).otherwise(0), "first_block": o * 10, "last_block": o * 10 + o % 13})
    found = S.scope_summary(places, chosen(spark, sf_dir))
    pages = F.array_join(F.transform("pages", lambda p: F.concat_ws("-", p["first"].cast("string"), p["last"].cast("string"))), ",")
    return found.select("query_id", "modules", "descendants", pages.alias("pages"), "blocks", F.array_join("boundaries", ",").alias("boundaries"), "missing")


@register("located_source_text", f"WITH {_PARTS} SELECT query_id, modules, source_text FROM t")
def located_source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = S.scope_rows(S.placed(trees(spark, sf_dir)), chosen(spark, sf_dir))
    return S.source_texts(scopes, module_inputs(spark, sf_dir))


@register(
    "source_hydrate",
    f"""WITH {_PARTS}, w AS (SELECT query_id, string_agg('## 命中模块 ' || k || '：' || name || chr(10) || x, chr(10) || chr(10) ORDER BY k) AS whole FROM (SELECT *, CASE ord % 20 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 13 THEN 4 ELSE 5 END AS k FROM i WHERE own) GROUP BY 1),
      u AS (SELECT query_id, CASE WHEN query_id % 3 = 2 THEN whole WHEN query_id % 3 = 1 THEN left(whole, 60) ELSE source_text END AS now, whole FROM t JOIN w USING (query_id))
      SELECT query_id, CASE WHEN query_id % 3 <> 2 AND (now LIKE '%预览已截断%' OR length(whole) > length(now) + 200) THEN 'used' ELSE 'complete' END AS hydrated, CASE WHEN query_id % 3 <> 2 AND (now LIKE '%预览已截断%' OR length(whole) > length(now) + 200) THEN whole ELSE now END AS source_text FROM u""",
)
def source_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are the located preview, the beginning of the whole, or the whole itself; the third module asked for is not there."""
    modules = module_inputs(spark, sf_dir)
    named = trees(spark, sf_dir).where((F.col("ord") % 20).isin(5, 6, 13, 15))
    place = F.col("ord") % 20
    wanted = named.select(F.col("doc_id").alias("query_id"), "doc_id", "node_id", F.when(place == 5, 1).when(place == 6, 2).when(place == 13, 4).otherwise(5).alias("number"))
    gone = wanted.where("number = 1").withColumn("node_id", F.lit("gone")).withColumn("number", F.lit(3))
    wanted = wanted.unionByName(gone)
    located = located_source_text(spark, sf_dir).join(S.whole_texts(wanted, modules), "query_id")
    k = F.col("query_id") % 3
    now = F.when(k == 2, F.col("whole_text")).when(k == 1, F.substring("whole_text", 1, 60)).otherwise(F.col("source_text"))
    return S.hydrated(located.select("query_id", now.alias("source_text")), wanted, modules).select("query_id", "hydrated", "source_text")


@register(
    "row_budget_cut",
    """WITH b AS (SELECT conv_id AS doc_id, turn AS ord, CASE WHEN turn % 4 <> 3 THEN length(text) % 17 END AS n FROM conversations), k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM b)
      SELECT doc_id, ord, CAST(CASE WHEN n IS NOT NULL THEN least(n, 32 - p) END AS INT) AS kept, n IS NOT NULL AND n > 32 - p AS cut FROM k WHERE n IS NULL OR n > 0 AND p < 32""",
)
def row_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks of a document: tables of up to sixteen rows, every fourth a text."""
    rows = F.when(F.col("turn") % 4 != 3, F.length("text") % 17)
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), rows.alias("rows"))
    return S.row_budget(blocks).select("doc_id", "ord", F.col("kept").cast("int").alias("kept"), "cut")
