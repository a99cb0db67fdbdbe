"""Queries over evidence packages, segments and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import packages as P
from leafline.operators import tables as T
from leafline.operators import tree
from leafline.plans.adapters import LINES, RUNS, line_tables, lines, runs, span_tables
from leafline.plans.merge_queries import HEADINGS, headings
from leafline.registry import register
from leafline.session import table


@register(
    "table_markdown",
    f"""WITH {LINES}, r AS (SELECT table_id, count(*) AS n, string_agg('| ' || concat_ws(' | ', line, part, quantity, price, flag, shipped) || ' |', chr(10) ORDER BY row_index) FILTER (row_index < 3) AS rows FROM lines GROUP BY 1)
      SELECT table_id, '| Line | Part | Quantity | Price | Flag | Shipped |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10) || rows || CASE WHEN n > 3 THEN chr(10) || '(' || (n - 3) || ' more rows)' ELSE '' END AS markdown FROM r""",
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.as_markdown(T.record_view(T.record_regions(T.grid(line_tables(spark, sf_dir), ids=False))), 3)


@register(
    "table_shape_v2",
    f"""WITH {LINES}, n AS (SELECT table_id, count(*) + 1 AS n, table_id % 9 = 0 AS complex FROM lines GROUP BY 1)
      SELECT table_id, CASE WHEN complex THEN 'complex_table' WHEN n >= 8 THEN 'record_table' ELSE 'table' END AS shape, n AS row_count, 6 AS column_count, CAST(0 AS BIGINT) AS field_rows, CAST(0 AS BIGINT) AS repeated_rows, CAST(0 AS BIGINT) AS empty_share FROM n""",
)
def table_shape_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_tables(spark, sf_dir)
    return P.table_shapes(T.grid(made, ids=False), made.select("table_id", (F.col("table_id") % 9 == 0).alias("complex")))


@register(
    "table_shape_fields",
    f"""WITH {LINES}, n AS (SELECT table_id, count(*) AS n, count(*) FILTER (flag = 'R') AS r FROM lines GROUP BY 1)
      SELECT table_id, CASE WHEN n >= 8 THEN 'mixed_table' ELSE 'kv_or_field_table' END AS shape, n AS row_count, 3 AS column_count, n AS field_rows, CAST(0 AS BIGINT) AS repeated_rows, CAST(r * 10000 // (3 * n) AS BIGINT) AS empty_share FROM n""",
)
def table_shape_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three cells as fields: a label with a colon, a value, and a flag that is blank where returned."""
    rows = lines(spark, sf_dir).select("table_id", (F.col("row_index") + 1).cast("int").alias("row_index"), F.array(F.concat("line", F.lit(":")), "price", F.when(F.col("flag") == "R", "").otherwise(F.col("flag"))).alias("cells"))
    return P.table_shapes(rows, rows.select("table_id", F.lit(False).alias("complex")).distinct())


@register(
    "table_segments",
    f"WITH {LINES}, n AS (SELECT table_id, count(*) AS n FROM lines GROUP BY 1) SELECT table_id, 1 AS segment, 'section' AS kind, 1 AS row_start, 1 AS row_end FROM n UNION ALL SELECT table_id, 2, 'records', 2, n + 2 FROM n",
)
def table_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table_segments(T.grids(span_tables(spark, sf_dir)))


@register("tree_text", f"WITH {HEADINGS} SELECT doc_id, ord, repeat('    ', level - 1) || substr(title, 1, 12) AS line FROM head")
def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tree_text(tree.heading_levels(headings(spark, sf_dir)), 12)


@register("tree_dispatch", f"WITH {HEADINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place FROM head) SELECT doc_id, printf('module_%03d', place) AS module_id, 'step_' || printf('module_%03d', place) AS step_id, CASE WHEN p.node_id IN (SELECT up FROM head WHERE up IS NOT NULL) THEN 60 ELSE 90 END AS confidence FROM p WHERE NOT (level = 1 AND place % 2 = 1)")
def tree_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    held = tree.heading_levels(headings(spark, sf_dir))
    pages = held.select("doc_id", "node_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) % 2 + 1).alias("page_count"))
    return tree.dispatch(tree.modules(held), pages).select("doc_id", "module_id", "step_id", "confidence")


@register(
    "model_backfill",
    """WITH l AS (SELECT p_size AS page_no, p_partkey AS table_no, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END AS html, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place FROM part),
      m AS (SELECT p_size AS page_no, upper(p_name) AS html, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place FROM part WHERE p_partkey % 2 = 0)
      SELECT l.page_no, table_no, CASE WHEN trim(l.html) = '' THEN m.html ELSE l.html END AS html, trim(l.html) = '' AND m.html IS NOT NULL AS filled FROM l LEFT JOIN m USING (page_no, place)""",
)
def model_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    layout = p.select(F.col("p_size").alias("page_no"), k.alias("table_no"), F.when(k % 3 == 0, " ").otherwise(F.col("p_name")).alias("html"))
    model = p.where("p_partkey % 2 = 0").select(F.col("p_size").alias("page_no"), k.alias("table_no"), F.upper("p_name").alias("html"))
    return P.backfilled(layout, model)


@register(
    "tree_ref_rebind",
    """WITH b AS (SELECT p_partkey AS block_id, p_size AS page_no FROM part WHERE p_partkey % 3 = 0 AND p_size > 3), f AS (SELECT page_no, min(block_id) AS near FROM b GROUP BY 1)
      SELECT p_partkey AS ref_id, coalesce(b.block_id, near) AS block_id, CASE WHEN b.block_id IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'page' ELSE 'unmatched' END AS how
      FROM part LEFT JOIN b ON b.block_id = p_partkey LEFT JOIN f ON f.page_no = p_size""",
)
def tree_ref_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.col("p_partkey").alias("ref_block"), F.col("p_size").alias("page_no"))
    blocks = p.where("p_partkey % 3 = 0 and p_size > 3").select(F.col("p_partkey").alias("block_id"), F.col("p_size").alias("page_no"))
    return P.rebound(refs, blocks)


@register(
    "fact_carry_over",
    """WITH b AS (SELECT o_orderpriority AS label, o_orderstatus AS value, min(o_custkey) AS source_page FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)
      SELECT o_orderkey AS field_id, o_orderpriority AS label, o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END AS value, source_page FROM orders LEFT JOIN b ON label = o_orderpriority AND b.value = o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END""",
)
def fact_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    value = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(""))
    reviewed = o.select(F.col("o_orderkey").alias("field_id"), F.col("o_orderpriority").alias("label"), value.alias("value"))
    previous = o.where("o_orderkey % 2 = 0").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("value"), F.col("o_custkey").alias("page_no"))
    return P.carried(reviewed, previous)


@register(
    "evidence_fallback",
    """WITH i AS (SELECT p_size AS group_id, p_partkey AS item_id, CASE WHEN p_partkey % 23 = 0 THEN 1 WHEN p_partkey % 5 = 0 THEN 2 ELSE 3 END AS step FROM part),
      c AS (SELECT group_id, CASE WHEN count(*) FILTER (step = 1) >= 3 THEN 1 WHEN count(*) FILTER (step <= 2) >= 3 THEN 2 ELSE 3 END AS last FROM i GROUP BY 1)
      SELECT group_id, item_id, step FROM i JOIN c USING (group_id) WHERE step <= last QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY step, item_id) <= 8""",
)
def evidence_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select(F.col("p_size").alias("group_id"), k.alias("item_id"), (k % 23 == 0).alias("strong"), (k % 5 == 0).alias("in_scope"))
    return P.with_fallback(items, 3, 8)


@register(
    "nearest_anchor",
    """WITH i AS (SELECT p_size AS page_no, p_partkey AS ord, p_partkey % 17 = 0 AS anchor FROM part), d AS (SELECT a.page_no, a.ord, min(abs(a.ord - b.ord)) AS d FROM i a LEFT JOIN i b ON a.page_no = b.page_no AND b.anchor GROUP BY 1, 2)
      SELECT page_no, ord, CASE WHEN d <= 120 THEN d END AS distance FROM d""",
)
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return P.nearest_anchor(table(spark, sf_dir, "part").select(F.col("p_size").alias("page_no"), k.alias("ord"), (k % 17 == 0).alias("anchor")), 120)


@register(
    "locator_roles",
    """WITH c AS (SELECT p_size AS query_id, p_partkey AS candidate_id, p_partkey % 50 AS page_no, CAST(p_retailprice * 100 AS BIGINT) % 90 AS score, list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS tokens FROM part),
      b AS (SELECT query_id, candidate_id AS id, page_no AS pp, tokens AS pt FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id DESC) = 1),
      s AS (SELECT c.*, id, pp, len(list_intersect(tokens, pt)) AS shared FROM c JOIN b USING (query_id))
      SELECT query_id, candidate_id, CASE WHEN candidate_id = id THEN 'primary' WHEN shared >= 6 OR (shared >= 4 AND page_no >= pp) THEN 'continuation' WHEN shared >= 2 THEN 'related' ELSE 'rejected' END AS role FROM s""",
)
def locator_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " "))
    score = (F.col("p_retailprice") * 100).cast("decimal(18,0)").cast("long") % 90
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("candidate_id"), (F.col("p_partkey") % 50).alias("page_no"), score.alias("score"), tokens.alias("tokens"))
    return P.roles(rows)


@register(
    "prompt_column_assignment",
    f"""WITH {LINES} SELECT table_id, unnest(['part', 'price', 'unit price', 'flags']) AS field, unnest([1, 3, NULL, 4]) AS column_index, unnest([1004, 1005, NULL, 104]) AS score FROM (SELECT DISTINCT table_id FROM lines)""",
)
def prompt_column_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unit price`` loses its column to the field that equals it, and is listed without one."""
    fields, headers = (F.array(*map(F.lit, x)) for x in (("part", "price", "unit price", "flags"), ("Line", "Part", "Quantity", "Price", "Flag", "Shipped")))
    return P.assigned(lines(spark, sf_dir).select("table_id").distinct().select("table_id", fields.alias("fields"), headers.alias("headers")))


@register("draft_dedupe", f"WITH {RUNS}, d AS (SELECT prompt_name || template_id AS key, run_id AS draft_id, run_id % 97 = 0 AS preferred, updated_at FROM runs), b AS (SELECT key, draft_id AS best FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY preferred DESC, updated_at DESC, draft_id DESC) = 1) SELECT key, best AS draft_id, string_agg(draft_id, ',' ORDER BY draft_id) FILTER (draft_id <> best) AS removed FROM d JOIN b USING (key) GROUP BY 1, 2")
def draft_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).select(F.concat("prompt_name", "template_id").alias("key"), F.col("run_id").alias("draft_id"), (F.col("run_id") % 97 == 0).alias("preferred"), "updated_at")
    return P.drafts(rows)


@register("validation_row_counts", f"WITH {LINES} SELECT table_id, count(*) AS expected, count(*) FILTER (flag <> 'N') AS actual, count(*) = count(*) FILTER (flag <> 'N') AS consistent FROM lines GROUP BY 1")
def validation_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("expected"), F.sum((F.col("flag") != "N").cast("long")).alias("actual"))
    return found.withColumn("consistent", F.col("expected") == F.col("actual"))


@register("metric_rollups", f"WITH {RUNS} SELECT status, count(*) AS items, CAST(sum(total_ms) AS BIGINT) AS total, count(DISTINCT prompt_name) AS labels, max(end_page - start_page + 1) AS most_pages, count(*) FILTER (error_message IS NOT NULL) AS errors FROM runs GROUP BY status")
def metric_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("items"), F.sum("total_ms").alias("total"), F.countDistinct("prompt_name").alias("labels"), F.max(F.col("end_page") - F.col("start_page") + 1).alias("most_pages"), F.count("error_message").alias("errors"))
