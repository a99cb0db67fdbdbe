"""Queries over content lists, artifacts, steps and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import documents as D
from leafline.plans.adapters import LINES, RUNS, lines, runs
from leafline.registry import register
from leafline.session import table
from leafline.sources import artifacts as A


def content_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as content lists: flat for even ones, nested by page for odd ones."""
    c = table(spark, sf_dir, "conversations")
    item = F.struct(F.lit("text").alias("type"), F.col("text"), F.when(F.col("role") == "user", 1).alias("text_level"), F.floor(F.col("turn") / 2).cast("int").alias("page_idx"))
    rows = c.select("conv_id", "turn", F.floor(F.col("turn") / 2).cast("int").alias("page"), item.alias("item"))
    flat = rows.where("conv_id % 2 = 0").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"])).alias("content"))
    paged = rows.where("conv_id % 2 = 1").groupBy("conv_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"]).alias("items"))
    nested = paged.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("page", "items"))), lambda x: x["items"])).alias("content"))
    return flat.unionByName(nested)


@register(
    "content_list_blocks",
    """SELECT conv_id AS doc_id, CAST(CASE WHEN conv_id % 2 = 0 THEN turn // 2 + 1 ELSE dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 2) END AS INT) AS page_no,
      CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS ord, CASE WHEN role = 'user' THEN 'title' ELSE 'text' END AS kind, 1 AS level, text, '' AS html FROM conversations""",
)
def content_list_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.content_blocks(content_lists(spark, sf_dir), "conv_id")


@register("artifact_rows", """SELECT c_custkey AS id, sha256(b) AS content_hash, CAST(strlen(b) AS BIGINT) AS size_bytes, 'customer/' || c_custkey || '.json' AS object_key, b AS body FROM (SELECT c_custkey, '{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS b FROM customer)""")
def artifact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.artifacts(table(spark, sf_dir, "customer"), "c_custkey", "customer", ["c_name", "c_mktsegment"])


@register("upsert_rows", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 50 = 0")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changes = base.where("c_custkey % 3 = 0").withColumn("segment", F.lit("changed")).unionByName(base.where("c_custkey % 50 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("segment")))
    return A.upsert(base, changes, ["c_custkey"])


@register("replace_scope", "SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 2, 1000 + n_nationkey, 'again' FROM nation WHERE n_nationkey < 3")
def replace_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    rows = base.where("n_nationkey < 3").select(F.lit(2).alias("n_regionkey"), (F.col("n_nationkey") + 1000).alias("n_nationkey"), F.lit("again").alias("n_name"))
    return A.replace_scope(base, rows, ["n_regionkey"])


@register(
    "step_chain",
    f"""WITH {RUNS}, s AS (SELECT task_id AS run_id, run_id AS step_id, 'k' || run_id AS output_key, CASE WHEN run_id % 4 = 0 THEN [] ELSE ['k' || (run_id - 7), 'k' || (run_id - 11)] END AS input_keys, status FROM runs),
      a AS (SELECT run_id, step_id, unnest(input_keys) AS key FROM s), m AS (SELECT a.run_id, a.step_id, count(*) AS n, count(*) FILTER (b.status = 'completed') AS r FROM a LEFT JOIN s b ON a.run_id = b.run_id AND a.key = b.output_key GROUP BY 1, 2)
      SELECT run_id, step_id, coalesce(n, 0) AS inputs, coalesce(r, 0) AS ready, coalesce(n, 0) = coalesce(r, 0) AS can_begin FROM s LEFT JOIN m USING (run_id, step_id)""",
)
def step_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("run_id")
    keys = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("k"), (k - 7).cast("string")), F.concat(F.lit("k"), (k - 11).cast("string"))))
    steps = runs(spark, sf_dir).select(F.col("task_id").alias("_t"), F.col("run_id").alias("step_id"), F.concat(F.lit("k"), k.cast("string")).alias("output_key"), keys.alias("input_keys"), "status")
    return D.step_inputs(steps.withColumnRenamed("_t", "run_id"))


@register(
    "application_detail",
    """WITH v AS (SELECT p_size AS application_id, p_partkey AS version, CASE p_partkey % 9 WHEN 0 THEN 'draft' WHEN 1 THEN 'archived' WHEN 2 THEN 'archived' ELSE 'published' END AS state FROM part),
      a AS (SELECT DISTINCT p_size AS application_id, p_size * 3 AS requested FROM part),
      r AS (SELECT a.application_id, version, state, CASE WHEN version = requested THEN 3 WHEN state = 'draft' THEN 2 WHEN state = 'published' THEN 1 END AS r FROM a JOIN v USING (application_id)),
      b AS (SELECT * FROM r WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY r DESC, version DESC) = 1)
      SELECT application_id, version, state FROM a LEFT JOIN b USING (application_id)""",
)
def application_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    m = F.col("p_partkey") % 9
    state = F.when(m == 0, "draft").when(m.isin(1, 2), "archived").otherwise("published")
    versions = p.select(F.col("p_size").alias("application_id"), F.col("p_partkey").alias("version"), state.alias("state"))
    applications = p.select(F.col("p_size").alias("application_id"), (F.col("p_size") * 3).alias("requested")).distinct()
    return D.chosen_versions(applications, versions)


@register(
    "output_counts",
    f"""WITH {LINES}, o AS (SELECT table_id AS output_id, CASE table_id % 4 WHEN 0 THEN 'record_collection' WHEN 1 THEN 'data_table' WHEN 2 THEN 'field_list' ELSE 'structured_object' END AS kind, count(*) AS n FROM lines GROUP BY ALL)
      SELECT output_id, CASE WHEN kind = 'record_collection' THEN n ELSE 0 END AS records, CASE WHEN kind IN ('data_table', 'record_collection') THEN n ELSE 0 END AS rows, CASE WHEN kind = 'field_list' THEN n ELSE 0 END AS fields, CASE WHEN kind = 'structured_object' THEN n ELSE 0 END AS components FROM o""",
)
def output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("table_id") % 4
    kind = F.when(m == 0, "record_collection").when(m == 1, "data_table").when(m == 2, "field_list").otherwise("structured_object")
    sizes = lines(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("size"))
    return D.output_counts(sizes.select(F.col("table_id").alias("output_id"), kind.alias("kind"), "size"))


_TABLES = f"{LINES}, t AS (SELECT table_id // 20 AS doc_id, table_id AS table_no, count(*) AS rows, CASE WHEN table_id % 3 = 0 THEN 'h' || table_id END AS header, table_id % 2 AS width FROM lines GROUP BY ALL)"


def document_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("table_id")
    return lines(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("rows")).select(F.floor(k / 20).alias("doc_id"), k.alias("table_no"), "rows", F.when(k % 3 == 0, F.concat(F.lit("h"), k.cast("string"))).alias("header"), (k % 2).alias("width"))


@register("header_inherit", f"WITH {_TABLES} SELECT doc_id, table_no, width, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id, width ORDER BY table_no) AS header, header IS NULL AS inherited FROM t")
def header_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.inherited_headers(document_tables(spark, sf_dir))


@register(
    "table_risk",
    f"""WITH {LINES}, t AS (SELECT table_id // 10 AS doc_id, table_id AS table_no, count(*) AS rows, any_value(flag) FILTER (row_index = 0) AS flag FROM lines GROUP BY 1, 2),
      k AS (SELECT *, CASE WHEN table_no % 2 = 0 THEN 6 ELSE 5 END AS width FROM t), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, width ORDER BY table_no) > 1 AND flag <> 'R' AS again FROM k),
      m AS (SELECT doc_id, table_no, concat_ws(',', CASE WHEN rows >= 5 THEN 'large_table' END, CASE WHEN table_no % 11 = 0 THEN 'matrix_table_shape' END, CASE WHEN rows % 4 = 0 THEN 'ragged_rows' END, CASE WHEN again THEN 'possible_continuation_without_header' END) AS marks FROM s)
      SELECT doc_id, table_no, marks, CASE WHEN marks = '' THEN 'none' WHEN marks = 'large_table' THEN 'warning' ELSE 'critical' END AS severity FROM m""",
)
def table_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a table: of half the tables in a document one width, of the others another; first rows of data unless returned."""
    made = lines(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("rows"), F.max(F.when(F.col("row_index") == 0, F.struct("line", "part", "quantity", "price", "flag"))).alias("r"))
    t = F.col("table_id")
    width = F.when(t % 2 == 0, 6).otherwise(5)
    data = F.array("r.line", "r.part", "r.quantity", "r.price")
    first = F.when(F.col("r.flag") == "R", F.array(*map(F.lit, ("Line", "Part", "Quantity", "Price")))).otherwise(data)
    tables = made.select(
        F.floor(t / 10).alias("doc_id"), t.alias("table_no"), width.alias("width"), F.when(F.col("rows") % 4 == 0, width - 1).otherwise(width).alias("min_width"), width.alias("max_width"),
        F.when(F.col("rows") >= 5, F.array(F.lit("large_table"))).otherwise(F.array().cast("array<string>")).alias("marks"), (t % 11 == 0).alias("matrix"), F.lit(False).alias("complex"), first.alias("first_row"),
    )
    return D.table_risks(tables)


@register("fast_path_cache", f"WITH {_TABLES} SELECT table_no, rows >= 4 AND header IS NOT NULL AS fast, sha256(concat_ws(chr(1), 'skill', 'a,b', header, CAST(width AS VARCHAR))) AS cache_key FROM t")
def fast_path_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.mapping_keys(document_tables(spark, sf_dir), "skill", ["a", "b"]).select("table_no", ((F.col("rows") >= 4) & F.col("header").isNotNull()).alias("fast"), "cache_key")


@register(
    "page_number_chain",
    """WITH q AS (SELECT p_partkey AS request_id, CASE WHEN p_partkey % 5 = 0 THEN p_size % 12 END AS page, CASE WHEN p_partkey % 5 IN (0, 1) THEN p_size % 8 + 1 END AS s, CASE WHEN p_partkey % 5 IN (0, 1) THEN p_size % 8 + 3 END AS e,
        CASE WHEN p_partkey % 5 = 2 THEN [p_size % 9, p_size % 4] END AS refs, CASE WHEN p_partkey % 5 = 3 THEN 'see Page ' || (p_size % 11) ELSE p_name END AS text, [5, 1, 3, 4, 2] AS av FROM part),
      l AS (SELECT request_id, av, list_filter(CASE WHEN page IS NULL THEN [] ELSE [page] END, lambda x: list_contains(av, x)) AS a, list_filter(CASE WHEN s IS NULL THEN [] ELSE range(s, e + 1) END, lambda x: list_contains(av, x)) AS b,
        list_filter(list_distinct(coalesce(refs, [])), lambda x: list_contains(av, x)) AS c, list_filter(CASE WHEN regexp_matches(text, '(?i)page\\s*[0-9]') THEN [CAST(regexp_extract(text, '(?i)page\\s*([0-9]{1,4})', 1) AS INT)] ELSE [] END, lambda x: list_contains(av, x)) AS d FROM q)
      SELECT request_id, array_to_string(list_sort(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN len(c) > 0 THEN c WHEN len(d) > 0 THEN d ELSE av END), ',') AS pages FROM l""",
)
def page_number_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_size")
    requests = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"), F.when(k == 0, n % 12).alias("page"), F.when(k.isin(0, 1), n % 8 + 1).alias("start"), F.when(k.isin(0, 1), n % 8 + 3).alias("end"),
        F.when(k == 2, F.array(n % 9, n % 4)).alias("refs"), F.when(k == 3, F.concat(F.lit("see Page "), (n % 11).cast("string"))).otherwise(F.col("p_name")).alias("text"), F.array(*map(F.lit, (5, 1, 3, 4, 2))).alias("available"),
    )
    return D.resolved_pages(requests).select("request_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@register("kv_value_map", "WITH v AS (SELECT o_custkey AS group_id, o_orderpriority AS key, o_orderstatus AS value, min(o_orderkey) AS o FROM orders GROUP BY ALL) SELECT group_id, key, string_agg(value, ' | ' ORDER BY o) AS \"values\", count(*) AS distinct_values FROM v GROUP BY 1, 2")
def kv_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.value_map(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("ord")))


@register(
    "output_merge",
    f"""WITH {RUNS} SELECT task_id AS run_id, string_agg(start_page || '-' || run_id, ',' ORDER BY start_page, run_id) AS outputs, coalesce((SELECT string_agg(e, '; ' ORDER BY e) FROM (SELECT DISTINCT CASE WHEN x.status = 'failed' THEN x.model END AS e FROM runs x WHERE x.task_id = r.task_id) WHERE e IS NOT NULL), '') AS errors,
      CASE WHEN bool_or(status = 'needs_review') THEN 'needs_review' ELSE 'completed' END AS status, min(start_page) AS start_page, max(start_page) AS end_page FROM runs r GROUP BY task_id""",
)
def output_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = runs(spark, sf_dir).select(F.col("task_id").alias("t"), F.col("start_page").alias("step"), F.col("run_id").alias("output_id"), F.when(F.col("status") == "failed", F.col("model")).alias("error"), "status", F.col("start_page").alias("page_no"))
    return D.merged_outputs(chunks.withColumnRenamed("t", "run_id"))


@register("record_to_object", f"""WITH {LINES} SELECT 'object:' || table_id AS id, count(*) AS rows, '[' || string_agg('{{"name":"' || part || '","amount":"' || price || '"}}', ',' ORDER BY row_index) || ']' AS table_json FROM lines GROUP BY table_id""")
def record_to_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = lines(spark, sf_dir).select(F.col("table_id").alias("record_id"), F.col("row_index").alias("ord"), F.col("part").alias("name"), F.col("price").alias("amount"))
    return D.record_objects(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id")), components)


_BOX = "({k} % 4) * 200 AS {p}x0, ({k} % 7) * 100 AS {p}y0, ({k} % 4) * 200 + 260 AS {p}x1, ({k} % 7) * 100 + 130 AS {p}y1"


_MATCH = f"""i AS (SELECT p_partkey // 40 AS page_no, p_partkey AS item_id, p_name AS item_text, p_type AS item_kind, {_BOX.format(k="p_partkey", p="i")} FROM part),
      b AS (SELECT p_partkey // 40 AS page_no, p_partkey AS block_id, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS block_text, p_type AS block_kind, {_BOX.format(k="(p_partkey + 3)", p="b")} FROM part),
      m AS (SELECT *, list_distinct(string_split(lower(item_text), ' ')) AS u, list_distinct(string_split(lower(block_text), ' ')) AS v, greatest(0, least(ix1, bx1) - greatest(ix0, bx0)) * greatest(0, least(iy1, by1) - greatest(iy0, by0)) AS sh FROM i JOIN b USING (page_no)),
      s AS (SELECT page_no, item_id, block_id, CASE WHEN item_kind = block_kind THEN 100 ELSE 0 END + CASE WHEN item_text = block_text THEN 120 WHEN contains(item_text, block_text) OR contains(block_text, item_text) THEN 80 ELSE len(list_intersect(u, v)) * 60 // greatest(len(u), len(v)) END
        + sh * 40 // ((ix1 - ix0) * (iy1 - iy0) + (bx1 - bx0) * (by1 - by0) - sh) AS score FROM m)"""


def placed_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as items and as blocks, forty a page, each in its box."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")

    def box(name: str, k) -> list:
        x, y = (k % 4) * 200, (k % 7) * 100
        return [x.alias(f"{name}x0"), y.alias(f"{name}y0"), (x + 260).alias(f"{name}x1"), (y + 130).alias(f"{name}y1")]

    page = F.floor(k / 40).alias("page_no")
    items = p.select(page, k.cast("long").alias("item_id"), F.col("p_name").alias("item_text"), F.col("p_type").alias("item_kind"), *box("i", k))
    text = F.when(k % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name"))
    return items, p.select(page, k.cast("long").alias("block_id"), text.alias("block_text"), F.col("p_type").alias("block_kind"), *box("b", k + 3))


@register("block_match_iou", f"WITH {_MATCH} SELECT page_no, item_id, block_id, CAST(score AS BIGINT) AS score FROM s")
def block_match_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.block_scores(*placed_parts(spark, sf_dir)).drop("overlap")


@register(
    "block_match_assigned",
    f"""WITH RECURSIVE {_MATCH.replace("AS score FROM m", "AS score, sh * 1000000 // ((ix1 - ix0) * (iy1 - iy0) + (bx1 - bx0) * (by1 - by0) - sh) AS overlap FROM m")},
      c AS (SELECT page_no, item_id, row_number() OVER (PARTITION BY page_no ORDER BY item_id) AS k, list(block_id ORDER BY score DESC, overlap DESC, block_id) AS fits FROM s WHERE score > 0 GROUP BY page_no, item_id),
      r AS (SELECT DISTINCT page_no, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS item_id, CAST(NULL AS BIGINT) AS block_id FROM c
        UNION ALL SELECT page_no, k, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got) END, item_id, got FROM (SELECT c.page_no, c.k, taken, c.item_id, list_filter(fits, lambda x: NOT list_contains(taken, x))[1] AS got FROM r JOIN c ON c.page_no = r.page_no AND c.k = r.k + 1))
      SELECT page_no, item_id, block_id, CAST(score AS BIGINT) AS score FROM r JOIN s USING (page_no, item_id, block_id)""",
)
def block_match_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with a block of its own; the oracle takes blocks in order by recursion, and a test compares with a plain loop."""
    return D.assigned_blocks(D.block_scores(*placed_parts(spark, sf_dir)))


@register("controlled_udf", "SELECT p_partkey, len(string_split(p_name, ' ')) AS result FROM part")
def controlled_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.controlled(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "word_count", "p_name").select("p_partkey", "result")


@register(
    "result_evidence_match",
    """WITH v AS (SELECT item_id AS value_id, text AS value FROM benchmark), b AS (SELECT doc_id AS block_id, doc_id // 10 AS page_no, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'text' END AS kind, lower(text) AS text FROM documents),
      m AS (SELECT value_id, block_id, page_no, least(length(value), 12) + CASE WHEN kind = 'table' THEN 2 ELSE 0 END AS score FROM v JOIN b ON contains(b.text, lower(value))), f AS (SELECT * FROM m QUALIFY page_no = min(page_no) OVER (PARTITION BY value_id))
      SELECT value_id, CAST(row_number() OVER (PARTITION BY value_id ORDER BY score DESC, block_id) AS INT) AS place, block_id, score FROM f QUALIFY place <= 2""",
)
def result_evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("value_id"), F.col("text").alias("value"))
    d = F.col("doc_id")
    blocks = table(spark, sf_dir, "documents").select(d.alias("block_id"), F.floor(d / 10).alias("page_no"), F.when(d % 3 == 0, "table").otherwise("text").alias("kind"), "text")
    return D.matched_blocks(values, blocks)
