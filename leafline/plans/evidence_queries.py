"""Queries over evidence, windows of rows, budgets and the locator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import evidence as E
from leafline.operators import merging as M
from leafline.plans.adapters import LINES, lines
from leafline.registry import register
from leafline.session import table

ITEMS = "items AS (SELECT doc_id AS id, doc_id // 10 AS page_no, substr(text, 1, 640) AS excerpt, n_chars < 1500 AS field_like, n_chars % 7 AS uncertainties FROM documents)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("page_no"), F.substring("text", 1, 640).alias("excerpt"), (F.col("n_chars") < 1500).alias("field_like"), (F.col("n_chars") % 7).alias("uncertainties")
    )


SCORED = f"""{ITEMS}, terms AS (SELECT DISTINCT regexp_replace(lower(split_part(text, ' ', 1)), '[^0-9a-zA-Z]+', '', 'g') AS t FROM benchmark),
  hit AS (SELECT id, count(t) AS hits FROM items LEFT JOIN terms ON length(t) >= 2 AND contains(regexp_replace(lower(excerpt), '[^0-9a-zA-Z]+', '', 'g'), t) GROUP BY id),
  base AS (SELECT i.*, hits, CASE WHEN hits > 0 THEN least(80, 24 + 8 * least(hits, 8)) ELSE 0 END + CASE WHEN field_like THEN 22 ELSE 0 END AS b FROM items i JOIN hit USING (id)),
  scored AS (SELECT id, page_no, CAST(hits AS INT) AS hits, CAST(greatest(0, CASE WHEN b = 0 THEN 8 ELSE b END - least(18, uncertainties * 3)) AS INT) AS score FROM base)"""


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("term"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score(items(spark, sf_dir), benchmark_terms(spark, sf_dir), fallback=True)


@register(
    "evidence_score_selected",
    f"""WITH {SCORED} SELECT id, page_no, CAST(hits AS INT) AS hits, CAST(CASE WHEN id % 17 = 0 THEN greatest(0, b + 45 + CASE WHEN page_no BETWEEN 3 AND 40 THEN 15 ELSE 0 END - least(18, uncertainties * 3)) ELSE 0 END AS INT) AS score FROM base""",
)
def evidence_score_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores where some items were selected: the others have none."""
    return E.score(items(spark, sf_dir), benchmark_terms(spark, sf_dir), F.col("page_no").between(3, 40), F.col("id") % 17 == 0)


@register("evidence_score", f"WITH {SCORED} SELECT * FROM scored")
def evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


@register("evidence_topk", f"WITH {SCORED} SELECT *, CAST(row_number() OVER (ORDER BY score DESC, page_no, id) AS INT) AS rank FROM scored QUALIFY rank <= 32")
def evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top(scored(spark, sf_dir))


@register(
    "evidence_topk_per_field",
    f"""WITH {ITEMS}, f AS (SELECT DISTINCT item_id AS field_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+')) AS w FROM benchmark), g AS (SELECT * FROM f WHERE length(w) >= 3),
      h AS (SELECT DISTINCT id, page_no, unnest(regexp_split_to_array(lower(excerpt), '[^a-z0-9à-ÿ]+')) AS w FROM items),
      c AS (SELECT field_id, id, page_no, count(*) AS hits FROM g JOIN h USING (w) GROUP BY ALL)
      SELECT field_id, CAST(row_number() OVER (PARTITION BY field_id ORDER BY hits DESC, page_no, id) AS INT) AS rank, id, hits FROM c QUALIFY rank <= 2""",
)
def evidence_topk_per_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("field_id"), F.col("text").alias("label"))
    return E.top_per_field(items(spark, sf_dir), fields)


_HIT = "flag = 'R' AND line = '2'"


@register(
    "row_window_v2",
    f"""WITH {LINES}, m AS (SELECT table_id, row_index, {_HIT} AS h, max(row_index) OVER (PARTITION BY table_id) AS last, bool_or({_HIT}) OVER (PARTITION BY table_id) AS any_,
        bool_or({_HIT}) OVER (PARTITION BY table_id ORDER BY row_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM lines)
      SELECT table_id, row_index, CASE WHEN h THEN 'hit' WHEN near THEN 'near' WHEN NOT any_ AND row_index < 3 THEN 'head' ELSE 'tail' END AS why FROM m WHERE h OR near OR (NOT any_ AND (row_index < 3 OR row_index = last))""",
)
def row_window_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.row_window(lines(spark, sf_dir), F.expr(_HIT), head=3)


@register(
    "row_window_v1",
    f"""WITH {LINES}, m AS (SELECT table_id, row_index, {_HIT} AS h, max(row_index) OVER (PARTITION BY table_id) AS last,
        bool_or({_HIT}) OVER (PARTITION BY table_id ORDER BY row_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM lines),
      p AS (SELECT table_id, row_index, CASE WHEN last < 3 THEN 0 WHEN h THEN 1 WHEN near THEN 2 WHEN row_index < 2 THEN 3 WHEN row_index > last - 1 THEN 4 END AS priority FROM m)
      SELECT * FROM p WHERE priority IS NOT NULL QUALIFY priority = 0 OR row_number() OVER (PARTITION BY table_id ORDER BY priority, row_index) <= 4""",
)
def row_window_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.priority_window(lines(spark, sf_dir), F.expr(_HIT), most=4, head=2, tail=1, whole=3)


@register(
    "row_budget",
    f"WITH {LINES}, t AS (SELECT table_id // 50 AS doc_id, table_id, count(*) AS rows FROM lines GROUP BY ALL), s AS (SELECT *, sum(rows) OVER (PARTITION BY doc_id ORDER BY table_id) AS spent FROM t) SELECT doc_id, table_id, rows, CAST(spent AS BIGINT) AS spent, CAST(96 - spent AS BIGINT) AS \"left\" FROM s WHERE spent <= 96",
)
def row_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = lines(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("rows")).select(F.floor(F.col("table_id") / 50).alias("doc_id"), "table_id", "rows")
    return E.within_budget(sizes, "doc_id", ["table_id"], "rows", 96)


@register(
    "locator_windows",
    f"""WITH {LINES}, h AS (SELECT table_id, row_index, greatest(row_index - 1, 0) AS s, row_index + 2 AS e FROM lines WHERE flag = 'R'),
      f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY table_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM h),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY table_id ORDER BY row_index) AS g FROM f)
      SELECT table_id, min(s) AS start, max(e) AS "end", count(*) AS hits FROM g GROUP BY table_id, g QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY start) <= 2""",
)
def locator_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.match_windows(lines(spark, sf_dir).where("flag = 'R'").select("table_id", "row_index"), before=1, after=2, most=2)


@register("chunk_context_rows", f"WITH {LINES} SELECT table_id, row_index // 3 AS chunk, row_index, lag(part) OVER w AS before, part AS anchor, lead(part) OVER w AS after FROM lines WINDOW w AS (PARTITION BY table_id ORDER BY row_index)")
def chunk_context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.context_rows(lines(spark, sf_dir).withColumnRenamed("part", "anchor"))


CANDIDATES = "cand AS (SELECT p_size AS query_id, p_partkey AS candidate_id, p_size % 4 AS rows, p_partkey % 6 AS columns, p_partkey % 3 = 0 AS type_match, p_partkey % 11 = 0 AS slot_in_title, p_partkey % 5 AS title_hits, p_partkey % 4 AS body_hits, p_partkey % 3 AS window_hits, p_partkey % 2 = 0 AS header_hit, CAST(p_partkey % 7 = 0 AS INT) * 2 AS negative_hits, p_partkey % 13 = 0 AS blocked FROM part)"
RECALL = f"""{CANDIDATES}, rec AS (SELECT *, CAST(greatest(0, least(98, 30 + CASE WHEN rows > 0 THEN 12 ELSE 0 END + CASE WHEN columns >= 3 THEN 8 ELSE 0 END + CASE WHEN type_match THEN 6 ELSE -6 END
  + CASE WHEN slot_in_title THEN 56 ELSE least(54, title_hits * 16) END + least(42, body_hits * 8) + least(34, window_hits * 6) + CASE WHEN header_hit THEN 8 ELSE 0 END - least(34, negative_hits * 9))) AS INT) AS score FROM cand)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_size").alias("query_id"), k.alias("candidate_id"), (F.col("p_size") % 4).alias("rows"), (k % 6).alias("columns"), (k % 3 == 0).alias("type_match"), (k % 11 == 0).alias("slot_in_title"),
        (k % 5).alias("title_hits"), (k % 4).alias("body_hits"), (k % 3).alias("window_hits"), (k % 2 == 0).alias("header_hit"), ((k % 7 == 0).cast("int") * 2).alias("negative_hits"), (k % 13 == 0).alias("blocked"),
    )


@register("locator_score", f"WITH {RECALL} SELECT query_id, candidate_id, score FROM rec QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id DESC) <= 12")
def locator_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("candidate_id")))
    return E.recall_score(candidates(spark, sf_dir)).withColumn("rank", rank).where("rank <= 12").select("query_id", "candidate_id", "score")


@register(
    "locator_gate",
    f"""WITH {RECALL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id DESC) AS r FROM rec),
      b AS (SELECT query_id, max(candidate_id) FILTER (r = 1) AS candidate_id, max(score) FILTER (r = 1) AS score, max(score) FILTER (r = 2) AS second, bool_or(blocked) FILTER (r = 1) AS blocked FROM r WHERE r <= 2 GROUP BY 1),
      w AS (SELECT query_id, candidate_id, score, greatest(score - coalesce(second, 0), 0) AS gap, concat_ws(',', CASE WHEN score < 70 THEN 'low_confidence' END, CASE WHEN greatest(score - coalesce(second, 0), 0) < 5 THEN 'small_gap' END, CASE WHEN blocked THEN 'blocking_warning' END) AS warnings FROM b)
      SELECT *, warnings = '' AS auto_execute FROM w""",
)
def locator_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.gate(E.recall_score(candidates(spark, sf_dir)))


@register(
    "column_vote_mapping",
    f"""WITH {LINES}, v AS (SELECT table_id, unnest(['part', 'flag']) AS field, unnest([part, flag]) AS value FROM lines WHERE row_index < 2),
      c AS (SELECT table_id, unnest(range(6)) AS column_index, unnest([line, part, quantity, price, flag, shipped]) AS value FROM lines),
      n AS (SELECT table_id, field, column_index, count(*) AS votes FROM v JOIN c USING (table_id, value) GROUP BY ALL)
      SELECT table_id, field, CAST(column_index AS INT) AS column_index, votes FROM n QUALIFY row_number() OVER (PARTITION BY table_id, field ORDER BY votes DESC, column_index) = 1""",
)
def column_vote_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    values = rows.where("row_index < 2").select("table_id", F.explode(F.create_map(F.lit("part"), "part", F.lit("flag"), "flag")).alias("field", "value"))
    cells = rows.select("table_id", F.posexplode(F.array("line", "part", "quantity", "price", "flag", "shipped")).alias("column_index", "value"))
    return M.column_votes(values, cells)
