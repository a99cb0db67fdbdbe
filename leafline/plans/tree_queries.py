"""Queries over whole document trees built from elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import ranges as G
from leafline.operators import repair as R
from leafline.operators import treebuild as B
from leafline.plans.merge_queries import HEADINGS, headings
from leafline.registry import register
from leafline.session import table

_E = """e AS (SELECT n_regionkey AS doc_id, CAST(n_nationkey + 1 AS BIGINT) * 1000000000000 AS ord, 'title' AS kind, CASE WHEN n_nationkey % 5 = 4 THEN '(' || n_nationkey || ') ' || n_name ELSE (n_regionkey + 1) || '.' || (n_nationkey + 1) || ' ' || n_name END AS content, 0 AS page FROM nation
  UNION ALL SELECT r_regionkey, 5, 'title', (r_regionkey + 1) || ' ' || r_name, 0 FROM region
  UNION ALL SELECT n_regionkey, CAST(n_nationkey + 1 AS BIGINT) * 1000000000000 + s_suppkey + 1, CASE s_suppkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'footer' ELSE 'text' END, s_name, s_suppkey % 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region as a document: its nations as headings, numbered or marked in brackets; suppliers as texts, tables and footers."""
    region, nation, supplier = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))
    base = (F.col("n_nationkey") + 1).cast("long") * 1_000_000_000_000
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    name = F.when(F.col("n_nationkey") % 5 == 4, text("(", F.col("n_nationkey"), ") ", F.col("n_name"))).otherwise(text(F.col("n_regionkey") + 1, ".", F.col("n_nationkey") + 1, " ", F.col("n_name")))
    n = nation.select(F.col("n_regionkey").alias("doc_id"), base.alias("ord"), F.lit("title").alias("kind"), name.alias("content"), F.lit(0).cast("long").alias("page"))
    r = region.select(F.col("r_regionkey").alias("doc_id"), F.lit(5).cast("long").alias("ord"), F.lit("title").alias("kind"), text(F.col("r_regionkey") + 1, " ", F.col("r_name")).alias("content"), F.lit(0).cast("long").alias("page"))
    s = F.col("s_suppkey")
    kind = F.when(s % 5 == 0, "table").when(s % 5 == 1, "footer").otherwise("text")
    body = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("doc_id"), (base + s + 1).alias("ord"), kind.alias("kind"), F.col("s_name").alias("content"), (s % 3).cast("long").alias("page"))
    both = r.unionByName(n).unionByName(body)
    none = F.lit(None).cast("double")
    return both.select("*", F.lit(1).alias("level"), F.concat(F.lit("b"), F.col("ord").cast("string")).alias("block_id"), F.lit(None).cast("string").alias("image_of"), F.when(F.col("kind") == "table", F.col("content")).alias("title"), F.lit("<table>").alias("html"), *[none.alias(c) for c in ("x0", "y0", "x1", "y1")])


@register(
    "tree_build_full",
    f"""WITH {_E}, h AS (SELECT *, CASE WHEN content LIKE '(%' THEN 0 ELSE len(string_split(string_split(content, ' ')[1], '.')) END AS n FROM e WHERE kind = 'title'),
      l AS (SELECT *, CASE WHEN n > 0 THEN n ELSE 1 + last_value(CASE WHEN n > 0 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) END AS level FROM h),
      p AS (SELECT *, CASE level WHEN 1 THEN -1 WHEN 2 THEN max(CASE WHEN level = 1 THEN ord END) OVER w ELSE max(CASE WHEN level <= 2 THEN ord END) OVER w END AS parent_ord FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      a AS (SELECT e.doc_id, e.ord, e.kind, e.content, max(CASE WHEN kind = 'title' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS owner, page, row_number() OVER (PARTITION BY doc_id, page, kind ORDER BY ord) - 1 AS k FROM e)
      SELECT doc_id, ord, 'text' AS kind, content AS title, CAST(level AS INT) AS level, parent_ord FROM p
      UNION ALL SELECT doc_id, ord, kind, content, -1, owner FROM a WHERE kind = 'table'
      UNION ALL SELECT doc_id, ord, kind, 'Page ' || page || ' - footer' || CASE WHEN k = 0 THEN '' ELSE ' - ' || k END, -1, -1 FROM a WHERE kind = 'footer'""",
)
def tree_build_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.built(elements(spark, sf_dir))


@register(
    "tree_components",
    f"""WITH {_E}, o AS (SELECT *, max(CASE WHEN kind = 'title' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS owner FROM e WHERE kind IN ('title', 'text'))
      SELECT doc_id, owner AS ord, max(content) FILTER (kind = 'title') AS title, coalesce(string_agg(content, chr(10) ORDER BY ord) FILTER (kind = 'text'), '') AS content, count(*) AS blocks FROM o GROUP BY 1, 2""",
)
def tree_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.components(elements(spark, sf_dir)).select("doc_id", "ord", "title", "content", F.size("block_ids").cast("long").alias("blocks"))


@register("tree_table_lookup", f"WITH {_E} SELECT doc_id, page, '1' AS title, arg_max('<' || content, ord) AS html, max(ord) AS ord FROM e WHERE kind = 'table' GROUP BY 1, 2")
def tree_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the tables of one title on a page the last stays."""
    return B.table_lookup(elements(spark, sf_dir).withColumn("title", F.lit(" 1 ")).withColumn("html", F.concat(F.lit("<"), "content")))


@register(
    "tree_range_match",
    """WITH n AS (SELECT p_size AS doc_id, p_partkey // 40 AS page, p_partkey AS node_id, p_partkey % 4 * 200 AS x0, p_partkey % 7 * 100 AS y0 FROM part), r AS (SELECT doc_id, page, node_id AS range_id, x0 + 30 AS x0, y0 + 40 AS y0 FROM n WHERE node_id % 2 = 0),
      s AS (SELECT n.doc_id, node_id, range_id, greatest(0, least(n.x0 + 260, r.x0 + 200) - greatest(n.x0, r.x0)) * greatest(0, least(n.y0 + 130, r.y0 + 100) - greatest(n.y0, r.y0)) * 1000 // 20000 AS score FROM n JOIN r USING (doc_id, page))
      SELECT doc_id, node_id, range_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, node_id ORDER BY score DESC, range_id) = 1""",
)
def tree_range_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.floor(k / 40).alias("page"), k.alias("node_id"), (k % 4 * 200).alias("x0"), (k % 7 * 100).alias("y0"), (k % 4 * 200 + 260).alias("x1"), (k % 7 * 100 + 130).alias("y1"))
    x, y = F.col("x0") + 30, F.col("y0") + 40
    ranges = nodes.where(F.col("node_id") % 2 == 0).select("doc_id", "page", F.col("node_id").alias("range_id"), x.alias("x0"), y.alias("y0"), (x + 200).alias("x1"), (y + 100).alias("y1"))
    return B.range_matches(nodes, ranges)


@register(
    "visual_headings",
    """WITH e AS (SELECT n_regionkey AS doc_id, n_nationkey AS k, n_nationkey % 3 AS w, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation), f AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM e)
      SELECT doc_id, k + 1 AS ord, CASE WHEN w = 0 THEN 1 ELSE 2 END AS level FROM f""",
)
def visual_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings without numbers: a third of them centred, none close to another; levels by how they stand."""
    k = F.col("n_nationkey")
    centred = k % 3 == 0
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("doc_id"), (k + 1).cast("long").alias("ord"), F.lit("title").alias("kind"), F.lit(1).alias("level"), k.cast("long").alias("page"), F.col("n_name").alias("content"), F.concat(F.lit("b"), k.cast("string")).alias("block_id"),
        F.when(centred, 400.0).otherwise(50.0).alias("x0"), F.lit(10.0).alias("y0"), F.when(centred, 600.0).otherwise(1000.0).alias("x1"), F.lit(30.0).alias("y1"),
    )
    return B.levelled(B.components(rows)).select("doc_id", "ord", "level")


@register("tree_repair", f"WITH {HEADINGS} SELECT doc_id, node_id, up AS parent_id, CASE WHEN node_id LIKE 's%' AND (CAST(substr(up, 2) AS INT) + 1) % 3 = 0 THEN 1 ELSE level END AS level FROM head")
def tree_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that were all given one level and lie below the root, but for every third nation's suppliers, which lie below their nation and keep that level."""
    given = headings(spark, sf_dir).withColumn("kind", F.lit("title")).withColumn("level", F.lit(1))
    number = F.split_part(F.split_part("title", F.lit(" "), F.lit(1)), F.lit("."), F.lit(2))
    nation = F.when(F.col("node_id").startswith("s") & (number.cast("int") % 3 == 0), F.concat(F.lit("n"), (number.cast("int") - 1).cast("string")))
    return R.repaired(given.withColumn("parent_id", nation))


@register(
    "tree_range_text",
    r"""WITH p AS (SELECT p_partkey AS k, p_partkey // 400 AS doc_id, p_partkey // 40 AS page, lower(regexp_replace(p_name || p_type, '[^\p{L}\p{N}]+', '', 'g')) AS a, lower(regexp_replace(p_name || CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_brand END, '[^\p{L}\p{N}]+', '', 'g')) AS b FROM part),
      m AS (SELECT n.doc_id, n.k AS node_id, r.k AS range_id, n.k % 50 <> 0 AS same, CASE WHEN length(n.a) <= length(r.b) THEN n.a ELSE r.b END AS s, CASE WHEN length(n.a) <= length(r.b) THEN r.b ELSE n.a END AS l
        FROM p n JOIN p r ON r.doc_id = n.doc_id AND r.k % 2 = 0 AND (n.k % 50 = 0 OR r.page IN (n.page, n.page + 1))),
      c AS (SELECT *, CASE WHEN same THEN 0.08::DOUBLE ELSE 0::DOUBLE END + CASE WHEN contains(l, s) THEN 0.6::DOUBLE ELSE 0::DOUBLE END + CASE WHEN contains(l, left(s, 180)) THEN 0.22::DOUBLE ELSE 0::DOUBLE END
        + least(0.32::DOUBLE, len(list_filter(list_distinct(string_split(s, '')), lambda x: contains(l, x)))::DOUBLE / len(list_distinct(string_split(s, ''))) * 0.32::DOUBLE) AS score FROM m)
      SELECT doc_id, node_id, range_id, round(score, 6) AS score FROM c WHERE score >= 0.22 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY score DESC, range_id) = 1""",
)
def tree_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes by name and type, even ones as ranges by name and brand (some by their name alone), forty a page; every fiftieth node names no page."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    page = F.floor(k / 40).cast("int")
    pages = F.when(k % 50 == 0, F.array().cast("array<int>")).otherwise(F.array(page, page + 1))
    nodes = part.select(F.floor(k / 400).alias("doc_id"), k.alias("node_id"), pages.alias("pages"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    ranges = part.where(k % 2 == 0).select(F.floor(k / 400).alias("doc_id"), page.alias("page_no"), k.alias("ord"), k.alias("range_id"), F.concat_ws(" ", "p_name", F.when(k % 8 != 0, F.col("p_brand"))).alias("text"))
    return G.text_matches(nodes, ranges)
