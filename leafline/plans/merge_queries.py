"""Queries over merges, rules, validation and document trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import merging as M
from leafline.operators import rules as R
from leafline.operators import tree as T
from leafline.plans.adapters import LINES, RUNS, lines, runs
from leafline.registry import register
from leafline.session import table

CHAT = "chat AS (SELECT conv_id AS group_id, turn AS ord, CASE WHEN length(text) % 5 = 0 THEN 'skip' WHEN length(text) % 3 = 0 THEN 'merge_prev' ELSE 'keep' END AS decision, text FROM conversations)"


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    decision = F.when(n % 5 == 0, "skip").when(n % 3 == 0, "merge_prev").otherwise("keep")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("ord"), decision.alias("decision"), "text")


@register(
    "decision_fold",
    f"""WITH {CHAT}, k AS (SELECT *, CASE WHEN decision = 'keep' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM chat WHERE decision <> 'skip' WINDOW w AS (PARTITION BY group_id ORDER BY ord)),
      r AS (SELECT *, sum(s) OVER (PARTITION BY group_id ORDER BY ord) AS record FROM k), d AS (SELECT group_id, record, text, min(ord) AS o FROM r GROUP BY 1, 2, 3),
      t AS (SELECT group_id, record, string_agg(text, chr(10) ORDER BY o) AS text FROM d GROUP BY 1, 2)
      SELECT group_id, CAST(record AS BIGINT) AS record, min(ord) AS ord, count(*) AS parts, any_value(t.text) AS text FROM r JOIN t USING (group_id, record) GROUP BY 1, 2""",
)
def decision_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.decisions(chat(spark, sf_dir))


@register("scalar_first_merge", "SELECT conv_id, arg_min(role, turn) FILTER (trim(role) <> '') AS role, arg_min(text, turn) FILTER (length(text) % 2 = 0) AS text FROM conversations GROUP BY 1")
def scalar_first_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.length("text") % 2 == 0, F.col("text")))
    return M.first_filled(rows, "conv_id", ["turn"], ["role", "text"])


@register("chunk_row_dedupe", "SELECT conv_id AS group_id, 'a' || (turn % 3) AS anchor, turn AS row_index, min(text) AS text FROM conversations GROUP BY ALL")
def chunk_row_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.concat(F.lit("a"), (F.col("turn") % 3).cast("string")).alias("anchor"), F.col("turn").alias("row_index"), "text")
    copies = rows.withColumn("chunk", F.explode(F.array(F.lit(1), F.lit(2))))
    return M.chunk_rows(copies)


@register(
    "page_override_merge",
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND turn < 4 THEN 'override' ELSE role END AS role FROM conversations UNION ALL SELECT DISTINCT conv_id, CAST(99 AS BIGINT), 'added' FROM conversations",
)
def page_override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    changed = base.where("turn % 2 = 0 and turn < 4").withColumn("role", F.lit("override"))
    added = base.select("conv_id").distinct().select("conv_id", F.lit(99).cast("long").alias("turn"), F.lit("added").alias("role"))
    return M.overridden(base, changed.unionByName(added), ["conv_id", "turn"])


ISSUES = f"{RUNS}, iss AS (SELECT task_id AS group_id, ' ' || upper(prompt_name) AS title, CASE total_ms % 4 WHEN 0 THEN 'risk' WHEN 1 THEN 'attention' WHEN 2 THEN 'passed' ELSE 'open' END AS level, coalesce(output_text, error_message) AS detail, run_id % 3 AS specificity, run_id AS ord FROM runs), merged AS (SELECT group_id, lower(trim(title)) AS title, arg_max(level, row(specificity, CASE level WHEN 'risk' THEN 4 WHEN 'attention' THEN 3 WHEN 'passed' THEN 2 ELSE 1 END, length(detail), -ord)) AS level, arg_max(detail, row(specificity, CASE level WHEN 'risk' THEN 4 WHEN 'attention' THEN 3 WHEN 'passed' THEN 2 ELSE 1 END, length(detail), -ord)) AS detail, count(*) AS merged FROM iss GROUP BY 1, 2)"


def found_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("total_ms") % 4
    level = F.when(m == 0, "risk").when(m == 1, "attention").when(m == 2, "passed").otherwise("open")
    return runs(spark, sf_dir).select(F.col("task_id").alias("group_id"), F.concat(F.lit(" "), F.upper("prompt_name")).alias("title"), level.alias("level"), F.coalesce("output_text", "error_message").alias("detail"), (F.col("run_id") % 3).alias("specificity"), F.col("run_id").alias("ord"))


@register("issue_merge", f"WITH {ISSUES} SELECT * FROM merged")
def issue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.issues(found_issues(spark, sf_dir))


@register(
    "issue_summary",
    f"""WITH {ISSUES} SELECT group_id, CASE max(CASE level WHEN 'risk' THEN 4 WHEN 'attention' THEN 3 WHEN 'passed' THEN 2 ELSE 1 END) WHEN 4 THEN 'risk' WHEN 3 THEN 'attention' WHEN 2 THEN 'passed' ELSE 'open' END AS level,
      'risk:' || count(*) FILTER (level = 'risk') || ' attention:' || count(*) FILTER (level = 'attention') || ' passed:' || count(*) FILTER (level = 'passed') || ' open:' || count(*) FILTER (level = 'open') AS summary FROM merged GROUP BY 1""",
)
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.issue_summary(M.issues(found_issues(spark, sf_dir)))


@register("missing_fields_outer", "SELECT c_custkey, coalesce(CAST(n AS VARCHAR), '') AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def missing_fields_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "customer").select("c_custkey")
    actual = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("string").alias("orders"))
    return M.missing(expected, actual, ["c_custkey"])


@register(
    "fields_compared",
    """WITH e AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0)
      SELECT coalesce(e.k, a.k) AS field_key, e.v AS expected, a.v AS actual, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' WHEN e.v = a.v THEN 'same' ELSE 'changed' END AS state FROM e FULL JOIN a ON e.k = a.k""",
)
def fields_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("field_key"), F.col("c_mktsegment").alias("v"))
    other = c.where("field_key % 5 <> 0").withColumn("v", F.when(F.col("field_key") % 4 == 0, "other").otherwise(F.col("v")))
    return M.compared(c.where("field_key % 3 <> 0"), other, ["field_key"], "v", "v")


@register("missing_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < DATE '1994-01-01')")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers none of whose orders was finished early."""
    found = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderdate < date '1994-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return M.absent(table(spark, sf_dir, "customer").select("c_custkey"), found, ["c_custkey"])


def split_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order's lines over tables of two rows: headed, numbered columns only, headed alike, headed otherwise, and again."""
    rows = lines(spark, sf_dir).select(F.col("table_id").alias("doc_id"), F.floor(F.col("row_index") / 2).alias("table_no"), (F.col("row_index") % 2).alias("row_index"), F.array("line", "part", "quantity", "price").alias("cells"))
    kind = F.col("table_no") % 4
    headers = [F.array(*map(F.lit, names)) for names in (("Line", "Part", "Quantity", "Price"), ("列1", "列2", "列3", "列4"), ("Line no", "Part", "Qty", "Price"), ("Name", "Address", "City", "Phone"))]
    named = F.when(kind == 0, headers[0]).when(kind == 1, headers[1]).when(kind == 2, headers[2]).otherwise(headers[3])
    return rows.select("doc_id", "table_no").distinct().withColumn("headers", named), rows


@register(
    "continuation_consolidate",
    f"""WITH {LINES}, r AS (SELECT table_id AS doc_id, row_index // 2 AS table_no, row_index % 2 AS row_index, concat_ws('|', line, part, quantity, price) AS cells FROM lines),
      k AS (SELECT doc_id FROM r GROUP BY 1 HAVING count(DISTINCT table_no) >= 3), m AS (SELECT * FROM r SEMI JOIN k USING (doc_id) WHERE table_no % 4 <> 3)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY table_no, row_index) - 1 AS place, table_no, row_index, cells FROM m QUALIFY count(*) OVER (PARTITION BY doc_id) >= 3""",
)
def continuation_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, rows = split_tables(spark, sf_dir)
    return M.consolidated(tables, rows).withColumn("cells", F.array_join("cells", "|"))


@register("continuation_skipped", f"WITH {LINES} SELECT DISTINCT table_id AS doc_id, row_index // 2 AS table_no FROM lines WHERE (row_index // 2) % 4 = 3")
def continuation_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose headers are too unlike the first one's."""
    return M.continuations(*split_tables(spark, sf_dir)).where("not included").select("doc_id", "table_no")


@register(
    "rule_transform",
    """SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'Std' ELSE p_type END AS p_type, upper(regexp_replace(trim(p_name), '([a-z]+) ([a-z]+)', '\\2 \\1')) AS p_name, replace(p_brand, 'Brand#', 'B-') AS p_brand, translate(p_brand, '#', '') AS plain,
      CAST(p_type = 'STANDARD' AS INT) + CAST(upper(regexp_replace(trim(p_name), '([a-z]+) ([a-z]+)', '\\2 \\1')) <> p_name AS INT) + CAST(replace(p_brand, 'Brand#', 'B-') <> p_brand AS INT) AS changed FROM part""",
)
def rule_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        R.Rule("exact_mapping", ("p_type",), mappings={"STANDARD": "Std"}),
        R.Rule("trim", ("p_name",)),
        R.Rule("regex_replace", ("p_name",), pattern="^(.*?)([a-z]+) ([a-z]+)", replacement="$1$3 $2"),
        R.Rule("upper", ("p_name",)),
        R.Rule("remove_chars", ("p_brand",), pattern="#", target="plain"),
        R.Rule("replace", ("p_brand",), pattern="Brand#", replacement="B-"),
    ]
    return R.apply(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_brand"), ["p_type", "p_name", "p_brand"], rules)


@register(
    "quality_check",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS p_name, p_brand, p_size FROM part), d AS (SELECT p_name FROM p WHERE p_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
      SELECT p_partkey, concat_ws(',', CASE WHEN p.p_name IS NULL THEN 'missing:p_name' END, CASE WHEN NOT regexp_matches(CAST(p_size AS VARCHAR), '^[0-9]$') THEN 'format:p_size' END, CASE WHEN d.p_name IS NOT NULL THEN 'duplicate:p_name' END) AS failed FROM p LEFT JOIN d USING (p_name)""",
)
def quality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("p_name"), "p_brand", "p_size")
    return R.quality(rows, "p_partkey", ["p_name"], {"p_size": "^[0-9]$"}, ["p_name"])


@register(
    "schema_validate",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS VARCHAR) END AS nation, c_mktsegment AS segment FROM customer),
      e AS (SELECT c_custkey, concat_ws(',', CASE WHEN name IS NULL THEN 'required:name' END, CASE WHEN nation = 'n/a' THEN 'type:nation' END, CASE WHEN segment NOT IN ('BUILDING', 'MACHINERY') THEN 'enum:segment' END) AS errors FROM c)
      SELECT *, CASE WHEN errors = '' THEN 'completed' ELSE 'needs_review' END AS status FROM e""",
)
def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 7 != 0, F.col("c_name")).alias("name"), F.when(k % 5 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("nation"), F.col("c_mktsegment").alias("segment"))
    return R.validated(rows, "c_custkey", [R.Field("name", required=True), R.Field("nation", "number"), R.Field("segment", "enum", values=("BUILDING", "MACHINERY"))])


@register("kv_text_and_rules", "SELECT o_orderkey AS id, unnest(['status', 'total', 'buyer']) AS field, unnest([o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), CAST(o_custkey AS VARCHAR)]) AS value FROM orders")
def kv_text_and_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``label: value`` lines read by label and alias; later copies and unknown labels don't count."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Status: "), "o_orderstatus", F.lit("\nAmount due： "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("\nno label here\nOther: x\nBuyer:"), F.col("o_custkey").cast("string"), F.lit("\nstatus: again"))
    return R.line_pairs(o.select("o_orderkey", text.alias("text")), "o_orderkey", "text", {"status": (), "total": ("amount due",), "buyer": ("customer",)})


#: A document a region; its number, then its nations' and suppliers', in order.
HEADINGS = """head AS (SELECT r_regionkey AS doc_id, CAST(0 AS BIGINT) AS ord, 'r' || r_regionkey AS node_id, CAST(r_regionkey + 1 AS VARCHAR) || ' ' || r_name AS title, 1 AS level, NULL AS up FROM region
  UNION ALL SELECT n_regionkey, CAST(n_nationkey + 1 AS BIGINT) * 1000000000000, 'n' || n_nationkey, (n_regionkey + 1) || '.' || (n_nationkey + 1) || ' ' || n_name, 2, 'r' || n_regionkey FROM nation
  UNION ALL SELECT n_regionkey, CAST(n_nationkey + 1 AS BIGINT) * 1000000000000 + s_suppkey + 1, 's' || s_suppkey, (n_regionkey + 1) || '.' || (n_nationkey + 1) || '.' || s_suppkey || ' ' || s_name, 3, 'n' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as a document with its nations and suppliers as numbered headings."""
    region, nation, supplier = (table(spark, sf_dir, x) for x in ("region", "nation", "supplier"))

    def number(*parts):
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    base = (F.col("n_nationkey") + 1).cast("long") * 1_000_000_000_000
    r = region.select(F.col("r_regionkey").alias("doc_id"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.concat(number(F.col("r_regionkey") + 1), F.lit(" "), "r_name").alias("title"))
    n = nation.select(F.col("n_regionkey").alias("doc_id"), base.alias("ord"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.concat(number(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1), F.lit(" "), "n_name").alias("title"))
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("n_regionkey").alias("doc_id"), (base + F.col("s_suppkey") + 1).alias("ord"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.concat(number(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1, F.col("s_suppkey")), F.lit(" "), "s_name").alias("title"))
    return r.unionByName(n).unionByName(s)


@register("heading_levels", f"WITH {HEADINGS} SELECT node_id, level FROM head")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.heading_levels(headings(spark, sf_dir)).select("node_id", "level")


@register("tree_nesting", f"WITH {HEADINGS} SELECT node_id, up AS parent_id FROM head")
def tree_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.nested(T.heading_levels(headings(spark, sf_dir))).select("node_id", "parent_id")


@register(
    "tree_modules",
    f"""WITH {HEADINGS}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM head),
      e AS (SELECT *, coalesce(CASE level WHEN 1 THEN n + 1 WHEN 2 THEN min(CASE WHEN level <= 2 THEN place END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) ELSE place + 1 END, n + 1) AS over_ FROM p)
      SELECT doc_id, printf('module_%03d', place) AS module_id, node_id, level, over_ - place AS members FROM e""",
)
def tree_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.modules(T.heading_levels(headings(spark, sf_dir))).select("doc_id", "module_id", "node_id", "level", "members")


@register(
    "tree_scope",
    f"""WITH {HEADINGS} SELECT 'n' || n_nationkey AS anchor_id, node_id, CASE WHEN node_id = 'n' || n_nationkey THEN 'anchor' ELSE 'descendant' END AS reason
      FROM nation JOIN head ON (node_id = 'n' || n_nationkey OR up = 'n' || n_nationkey)""",
)
def tree_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = T.heading_levels(headings(spark, sf_dir))
    chosen = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"))
    return T.scope(held, chosen).select("anchor_id", "node_id", "reason")


@register(
    "reading_ranges",
    """WITH b AS (SELECT doc_id // 10 AS page_no, doc_id AS block_id, CASE WHEN n_chars % 4 = 0 THEN 'title' ELSE 'text' END AS kind, (doc_id % 3) * 100 AS x0, (doc_id % 10) * 90 AS y0, (doc_id % 3) * 100 + 300 AS x1, (doc_id % 10) * 90 + 50 + n_chars % 40 AS y1 FROM documents),
      f AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND y0 - lag(y1) OVER w <= 26 AND (least(x1, lag(x1) OVER w) - greatest(x0, lag(x0) OVER w)) * 100 >= least(x1 - x0, lag(x1) OVER w - lag(x0) OVER w) * 20 THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY page_no ORDER BY y0, x0, block_id)),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY page_no ORDER BY y0, x0, block_id) AS range_no FROM f)
      SELECT page_no, CAST(range_no AS BIGINT) AS range_no, any_value(kind) AS kind, count(*) AS blocks, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY 1, 2""",
)
def reading_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    blocks = table(spark, sf_dir, "documents").select(
        F.floor(d / 10).alias("page_no"), d.alias("block_id"), F.when(F.col("n_chars") % 4 == 0, "title").otherwise("text").alias("kind"),
        ((d % 3) * 100).alias("x0"), ((d % 10) * 90).alias("y0"), ((d % 3) * 100 + 300).alias("x1"), ((d % 10) * 90 + 50 + F.col("n_chars") % 40).alias("y1"),
    )
    return T.reading_ranges(blocks)


@register(
    "tree_grouped_body",
    """WITH e AS (SELECT conv_id AS doc_id, turn AS ord, CASE WHEN role = 'user' THEN 'title' ELSE 'other' END AS kind, text FROM conversations),
      g AS (SELECT *, max(CASE WHEN kind = 'title' THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS title_ord FROM e)
      SELECT doc_id, title_ord, count(*) FILTER (kind <> 'title') AS parts, CAST(coalesce(sum(length(text)) FILTER (kind <> 'title'), 0) AS BIGINT) AS chars, max(text) FILTER (kind = 'title') AS title FROM g GROUP BY 1, 2""",
)
def tree_grouped_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return T.grouped_body(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "user", "title").otherwise("other").alias("kind"), "text"))
