"""Queries over payload items, predicates, collected rows and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import predicates as X
from leafline.functions.text import structure_tokens, useful_terms, variants
from leafline.operators import export as E
from leafline.operators import payloads as P
from leafline.plans.adapters import LINES, lines
from leafline.registry import register
from leafline.session import table


@register(
    "cell_row_predicates",
    """WITH p AS (SELECT p_partkey, [CAST(p_partkey AS VARCHAR), p_name, p_brand, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END] AS a, [p_brand, p_brand, p_brand, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END] AS b, p_partkey % 3 AS k FROM part)
      SELECT p_partkey, true AS detail, false AS context, true AS business, CAST(k = 1 AS BOOLEAN) AS skipped_a, true AS skipped_b,
        concat_ws(',', CASE WHEN k <> 0 THEN a[1] END, CASE WHEN p_partkey % 4 <> 0 THEN a[4] END) AS kept, k = 0 AS raw FROM p""",
)
def cell_row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a part: numbered ones, and ones that one value fills; a header like the row in a third of them."""
    k = F.col("p_partkey")
    name, size = F.lower("p_name"), F.col("p_size").cast("string")
    a = F.array(k.cast("string"), F.col("p_name"), F.col("p_brand"), F.when(k % 4 == 0, "").otherwise(size))
    b = F.array(F.col("p_brand"), F.col("p_brand"), F.col("p_brand"), F.when(k % 2 == 0, "").otherwise(F.col("p_name")))
    header = F.when(k % 3 == 1, F.transform(a, lambda c: F.concat(F.lit(" "), F.upper(c)))).otherwise(F.array(name, name, name, name))
    row = F.create_map(F.lit("no"), F.when(k % 3 != 0, k.cast("string")).otherwise(""), F.lit("name"), F.col("p_name"), F.lit("size"), F.when(k % 4 == 0, "").otherwise(size))
    kept = F.array_join(F.map_values(X.kept_values(row, ["no", "size"])), ",")
    text = F.when(k % 3 == 0, F.concat(F.lit("see <TABLE border=1>"), "p_name")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select(k, a.alias("a"), b.alias("b"), header.alias("h"), kept.alias("kept"), X.raw_markup(text).alias("raw"))
    return rows.select("p_partkey", X.detail_row(F.col("a")).alias("detail"), X.context_row(F.col("a")).alias("context"), X.business_row(F.col("a")).alias("business"), X.skipped_row(F.col("a"), F.col("h")).alias("skipped_a"), X.skipped_row(F.col("b")).alias("skipped_b"), "kept", "raw")


@register("mode_blocks", "SELECT doc_id, doc_id % 5 IN (0, 1) AS as_text, doc_id % 5 = 2 AS as_table FROM documents")
def mode_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("Title", "list", "TABLE", "footer", "image"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", X.of_mode(kinds, "text").alias("as_text"), X.of_mode(kinds, "table").alias("as_table"))


@register("published_skills", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_mktsegment = 'BUILDING' AND (c_nationkey % 5 = 0 OR c_nationkey IN (1, 2, 3))")
def published_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner, version = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey"))
    return table(spark, sf_dir, "customer").where(X.published(version, F.col("c_mktsegment"), "BUILDING", owner, [1, 2, 3])).select("c_custkey")


@register(
    "payload_items",
    """WITH q AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_custkey % 7 AS n FROM orders)
      SELECT o_orderkey, CASE k WHEN 0 THEN n + 1 WHEN 1 THEN n + 2 WHEN 2 THEN n + 3 ELSE 9 END AS page_no, CASE WHEN k < 3 THEN '1.5|2.0|' || n || '.0|4.0' ELSE '' END AS box,
        CASE k WHEN 0 THEN 'plain ' || n WHEN 1 THEN 'a b ' || n WHEN 2 THEN 'in ' || n || ' deep' ELSE '' END AS flat FROM q""",
)
def payload_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as services write them: pages by index or number, boxes as numbers or text, text in strings, lists and objects."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("k"), (F.col("o_custkey") % 7).cast("string").alias("n"))
    n = F.col("n")

    def item(*parts) -> object:
        return F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts])

    json = (
        F.when(F.col("k") == 0, item('{"page_idx": ', n, ', "bbox": [1.5, 2, "', n, '", 4, 5], "content": "plain  ', n, '"}'))
        .when(F.col("k") == 1, item('{"page_no": ', (n.cast("int") + 2).cast("string"), ', "bbox": [1.5, 2, ', n, ', 4], "content": ["a", " ", {"text": "b"}, ["', n, '"]]}'))
        .when(F.col("k") == 2, item('{"page_idx": null, "pageNo": 0, "page": "', (n.cast("int") + 3).cast("string"), '", "bbox": [1.5, 2, ', n, ', 4], "content": {"content": "", "text": ["in ', n, '", {"item_content": {"content": "deep"}}]}}'))
        .when(F.col("k") == 3, item('{"page_no": "x", "bbox": [1, 2, "x", 4]}'))
        .otherwise(item('{"page": -1, "bbox": [1, 2]}'))
    )
    return o.select("o_orderkey", P.page_of(json, F.lit(8)).alias("page_no"), F.array_join(F.transform(P.box_of(json), lambda x: x.cast("string")), "|").alias("box"), P.flat_text(F.get_json_object(json, "$.content")).alias("flat"))


@register(
    "payload_projections",
    """SELECT c_custkey, '1. ' || c_name || chr(10) || '3. ' || c_mktsegment AS listed, c_name || ' | ' || c_mktsegment AS scalars, 'c_name,note' AS fields, 'c_name,note,token' AS traced,
      CASE WHEN c_nationkey >= 20 THEN 1.0 ELSE c_nationkey / 20.0 END AS high, least(len(c_name), 420) AS text_length, CAST(strlen('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS INT) AS bytes FROM customer""",
)
def payload_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    record = F.create_map(F.lit("c_name"), name, F.lit("cells"), segment, F.lit("note"), segment)
    traced = F.create_map(F.lit("BBox"), name, F.lit("c_name"), name, F.lit("note"), name, F.lit("token"), name)
    _, high = P.on_page(F.lit(0.0), F.col("c_nationkey").cast("double") + 1.5, F.lit(20.0))
    scope = P.compact_scope(F.array(name), F.array(name), name)
    rows = table(spark, sf_dir, "customer").withColumn("hidden", F.element_at(P.stripped(traced), F.lit("token")))
    return rows.where("hidden = '***'").select(
        "c_custkey", P.list_text(F.array(name, F.lit(" "), segment)).alias("listed"), P.scalar_text(F.array(name, F.lit(""), F.lit(None).cast("string"), segment)).alias("scalars"),
        F.array_join(F.map_keys(P.scalar_fields(record)), ",").alias("fields"), F.array_join(F.map_keys(P.stripped(traced)), ",").alias("traced"),
        P.on_page(F.lit(2.0), F.col("c_nationkey").cast("double"), F.lit(20.0))[1].alias("high"), F.length(F.struct(*scope)["text"]).alias("text_length"), P.payload_size("c_custkey", "c_name").alias("bytes"),
    )


@register(
    "module_summaries",
    f"""WITH {LINES}, t AS (SELECT table_id, count(*) AS n, string_agg('line ' || line, ' / ' ORDER BY row_index) FILTER (row_index < 3) AS a FROM lines GROUP BY 1),
      b AS (SELECT o_orderkey, 'T' || o_orderkey || '：' || o_custkey || ' 行' AS b FROM orders WHERE o_orderkey % 2 = 0)
      SELECT coalesce(table_id, o_orderkey) AS module_id, coalesce(n, 0) || ' 个文本节点，' || CASE WHEN b IS NULL THEN 0 ELSE 1 END || ' 个表格。' || coalesce(' ' || nullif(concat_ws(' / ', a, b), ''), '') AS summary FROM t FULL JOIN b ON table_id = o_orderkey""",
)
def module_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = lines(spark, sf_dir).select(F.col("table_id").alias("module_id"), F.col("row_index").alias("ord"), F.concat(F.lit("line "), "line").alias("text"))
    tables = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("module_id"), F.lit(1).alias("ord"), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_custkey").alias("rows"))
    return P.summaries(texts, tables)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's fields, its lines as a table with a header used twice and, for every third, as an object with components."""
    o = table(spark, sf_dir, "orders")
    none = {"label": "string", "value": "string", "headers": "array<string>", "rows": "array<array<string>>", "kv": "map<string,string>", "components": "array<map<string,string>>"}

    def made(held: DataFrame, **columns) -> DataFrame:
        return held.select("doc_id", "ord", "kind", *[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in none.items()])

    doc = o.select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_orderpriority")
    pairs = F.array(F.struct(F.lit(1).cast("long").alias("ord"), F.lit("Status").alias("l"), F.col("o_orderstatus").alias("v")), F.struct(F.lit(3).cast("long").alias("ord"), F.lit(" Priority ").alias("l"), F.col("o_orderpriority").alias("v")), F.struct(F.lit(2).cast("long").alias("ord"), F.lit("Blank").alias("l"), F.lit(" ").alias("v")))
    fields = doc.select("doc_id", F.inline(pairs)).withColumn("kind", F.lit("field"))
    held = lines(spark, sf_dir).groupBy(F.col("table_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("row_index", "line", "part", "flag"))).alias("x"))
    flat = held.withColumn("ord", F.lit(9).cast("long"))
    tables = flat.where("doc_id % 3 <> 0").withColumn("kind", F.lit("table"))
    objects = flat.where("doc_id % 3 = 0").withColumn("kind", F.lit("object"))
    rows = F.transform("x", lambda r: F.array(r["line"], r["flag"], r["part"]))
    parts = F.transform("x", lambda r: F.create_map(F.lit("Line"), r["line"], F.lit("Part"), r["part"]))
    return (
        made(fields, label=F.col("l"), value=F.col("v"))
        .unionByName(made(tables, headers=F.array(F.lit("Line"), F.lit("Part"), F.lit("Part")), rows=rows))
        .unionByName(made(objects, kv=F.create_map(F.lit("Lines"), F.size("x").cast("string"), F.lit("Empty"), F.lit("")), components=parts))
    )


_COLLECTED = f"""{LINES}, a AS (SELECT o_orderkey AS doc_id, -1 AS o, 0 AS i, unnest(['Status', 'Priority']) AS header, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders
  UNION ALL SELECT table_id, 9, 0, 'Lines', CAST(count(*) AS VARCHAR) FROM lines WHERE table_id % 3 = 0 GROUP BY table_id
  UNION ALL SELECT table_id, 9, row_index + CASE WHEN table_id % 3 = 0 THEN 1 ELSE 0 END, unnest(['Line', 'Part']), unnest([line, part]) FROM lines),
  r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY o, i) AS row_no FROM a)"""


@register("field_extract_rows", f"WITH {_COLLECTED} SELECT doc_id, CAST(row_no AS INT) AS row_no, header, value FROM r")
def field_extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.collected_rows(snapshots(spark, sf_dir)).select("doc_id", "row_no", F.explode("values").alias("header", "value"))


@register(
    "field_extract_export",
    f"""WITH {_COLLECTED}, h AS (SELECT DISTINCT doc_id, header FROM r WHERE header IN ('Part', 'Status')), n AS (SELECT DISTINCT doc_id, row_no FROM r WHERE header IN ('Part', 'Status')),
      k AS (SELECT doc_id, header, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY header <> 'Part') - 1 AS INT) AS header_no FROM h)
      SELECT doc_id, CAST(n.row_no AS INT) AS row_no, header_no, k.header, coalesce(value, '') AS value FROM n JOIN k USING (doc_id) LEFT JOIN r USING (doc_id, row_no, header)""",
)
def field_extract_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under two chosen headers; rows without any of them are left out, their number is not given again."""
    rows = E.collected_rows(snapshots(spark, sf_dir))
    return E.extracted(rows, ["Part", "Status"])


@register("instructed_rules", "SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'Std' WHEN 'PROMO' THEN 'Deal' ELSE p_type END AS p_type, CAST(p_type IN ('STANDARD', 'PROMO') AS INT) AS changed FROM part")
def instructed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dispatched(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "local_instruction", {"fields": ["p_type"], "instruction": "Please shorten:\nSTANDARD -> Std\nPROMO => Deal\nthank you"})


@register(
    "locator_terms",
    """WITH t AS (SELECT n_nationkey, replace(lower(n_name), '_', '') AS a FROM nation)
      SELECT n_nationkey, 'no_' || a || '|no ' || a || '|no' || a || '|No ' || upper(a[1]) || a[2:] || '|number ' || a || '|number' || a || '|num ' || a || '|num' || a AS variants, a || '|x-' || a AS useful, a || '|' || array_to_string(list_transform(range(1, least(length(a) - 1, 18) + 1), lambda i: substr(a, i, 2)), '|') AS tokens
      FROM t WHERE NOT contains(a, ' ') AND length(a) > 3 AND len(list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2)))) = length(a) - 1""",
)
def locator_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("a", F.replace(F.lower("n_name"), F.lit("_"), F.lit("")))
    a, size = F.col("a"), F.length("a")
    pairs = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(a, i, F.lit(2)))
    n = n.where(~F.contains(a, F.lit(" ")) & (size > 3) & (F.size(F.array_distinct(pairs)) == size - 1))
    useful = useful_terms(F.array(a, F.lit("ab"), F.lit("信息"), F.concat(F.lit("x-"), a), a, F.lit(" ")))
    return n.select("n_nationkey", F.array_join(variants(F.concat(F.lit("no_"), a)), "|").alias("variants"), F.array_join(useful, "|").alias("useful"), F.array_join(structure_tokens(a), "|").alias("tokens"))
