"""Queries over outputs of extraction, their targets, checks and merges, and over prompts' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import outputs as O
from leafline.operators import prompt_tables as T
from leafline.operators import tables as H
from leafline.plans.adapters import LINES, line_tables, lines
from leafline.plans.table_queries import kv_tables
from leafline.registry import register
from leafline.session import table


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs an order: its fields, and its lines as records, as a table or under an unknown kind; some without what they need."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    kinds = "run_id long, ord int, output_id string, kind string, title string, renderer string, fields map<string,string>, headers array<string>, rows array<array<string>>"
    types = {x.split(" ")[0]: x.split(" ")[1] for x in kinds.split(", ")}

    def made(held: DataFrame, **columns) -> DataFrame:
        return held.select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    fields = F.when(k % 5 != 0, F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")))
    first = made(o, run_id=k, ord=F.lit(1), kind=F.lit("field_list"), title=F.lit(" Facts "), fields=fields)
    held = lines(spark, sf_dir).groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line", "part"))), lambda r: F.array(r["line"], r["part"])).alias("rows"))
    t = F.col("table_id")
    kind = F.when(t % 3 == 0, "record_collection").when(t % 3 == 1, "data_table").otherwise("odd")
    second = made(held, run_id=t, ord=F.lit(2), output_id=F.lit("lines"), kind=kind, renderer=F.lit("grid"), headers=F.when(t % 7 != 0, F.array(F.lit("Line"), F.lit("Part"))), rows=F.col("rows"))
    return first.unionByName(second)


@register(
    "output_normalise",
    f"""WITH {LINES} SELECT o_orderkey AS run_id, 1 AS n, 'output-1' AS output_id, 'field_list' AS kind, 'Facts' AS title, 'auto' AS renderer, CASE WHEN o_orderkey % 5 = 0 THEN 'no_fields' END AS problem FROM orders
      UNION ALL SELECT DISTINCT table_id, CASE WHEN o_orderkey IS NULL THEN 1 ELSE 2 END, 'lines', CASE table_id % 3 WHEN 0 THEN 'record_collection' WHEN 1 THEN 'data_table' ELSE 'custom' END, 'output', 'grid', CASE WHEN table_id % 3 < 2 AND table_id % 7 = 0 THEN 'no_headers' END FROM lines LEFT JOIN orders ON o_orderkey = table_id""",
)
def output_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.normalised(raw_outputs(spark, sf_dir)).select("run_id", "n", "output_id", "kind", "title", "renderer", "problem")


@register(
    "output_targets",
    f"""WITH {LINES} SELECT o_orderkey AS run_id, 'output:output-1' AS target_id, 'output' AS target_kind, 'Facts' AS label FROM orders
      UNION ALL SELECT o_orderkey, unnest(['field:output-1:0', 'field:output-1:1']), 'field', unnest(['status', 'priority']) FROM orders WHERE o_orderkey % 5 <> 0
      UNION ALL SELECT DISTINCT table_id, 'output:lines', 'output', 'output' FROM lines
      UNION ALL SELECT DISTINCT table_id, 'table:lines', CASE table_id % 3 WHEN 0 THEN 'record_collection' ELSE 'table' END, 'Line | Part' FROM lines WHERE table_id % 3 < 2 AND table_id % 7 <> 0
      UNION ALL SELECT table_id, 'record:lines:' || row_index, 'record', line FROM lines WHERE table_id % 3 = 0 AND table_id % 7 <> 0""",
)
def output_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.targets(O.normalised(raw_outputs(spark, sf_dir)))


@register(
    "output_legacy",
    f"""WITH {LINES} SELECT o_orderkey AS run_id, unnest(['status', 'priority']) AS name, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders WHERE o_orderkey % 5 <> 0
      UNION ALL SELECT table_id, 'table', '2x' || count(*) FROM lines WHERE table_id % 3 < 2 AND table_id % 7 <> 0 GROUP BY table_id""",
)
def output_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = O.normalised(raw_outputs(spark, sf_dir))
    fields = O.legacy_fields(made).select("run_id", F.col("label").alias("name"), "value")
    return fields.unionByName(O.legacy_tables(made).select("run_id", F.lit("table").alias("name"), F.concat_ws("x", F.col("columns").cast("string"), F.col("rows").cast("string")).alias("value")))


@register("output_partial_rows", f"WITH {LINES} SELECT table_id AS run_id, 'lines' AS output_id, count(*) - 2 AS missing FROM lines WHERE table_id % 2 = 0 AND table_id % 3 <> 0 GROUP BY table_id HAVING count(*) > 2")
def output_partial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("table_id")
    made = lines(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("total_rows"))
    return O.partial_rows(made.select(t.alias("run_id"), F.lit("lines").alias("output_id"), F.when(t % 2 == 0, "record_collection").otherwise("data_table").alias("kind"), (t % 3 == 0).alias("fast_path"), F.least("total_rows", F.lit(2)).alias("selected_rows"), "total_rows"))


@register(
    "operation_problems",
    """SELECT p_partkey AS result_id, CASE WHEN k = 9 THEN 'no_summary' WHEN k = 4 THEN 'unknown_kind' WHEN p_partkey % 2 = 1 THEN '' ELSE CASE k WHEN 0 THEN 'no_decision' WHEN 1 THEN 'no_fields' WHEN 2 THEN 'no_headers' WHEN 3 THEN 'no_text' ELSE 'unknown_kind' END END AS problem
      FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 9 ELSE p_partkey % 5 END AS k FROM part)""",
)
def operation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("decision", "object", "table", "text", "odd"))), (k % 5 + 1).cast("int"))
    whole = k % 2 == 1
    rows = table(spark, sf_dir, "part").select(
        k.alias("result_id"), kind.alias("result_kind"), F.when(k % 11 != 0, "done").otherwise(" ").alias("summary"), F.when(whole, "yes").alias("decision"), F.when(whole, F.create_map(F.lit("a"), F.lit("b"))).alias("fields"),
        F.when(whole, F.array(F.lit("h"))).alias("headers"), F.when(whole, F.col("p_name")).otherwise("").alias("text"),
    )
    return O.operation_problems(rows)


@register(
    "issue_normalise",
    """SELECT p_partkey AS issue_id, CASE p_partkey % 4 WHEN 0 THEN 'risk' WHEN 1 THEN 'passed' WHEN 2 THEN 'attention' ELSE 'open' END AS level, substr(trim(p_name || ' ' || p_type || ' ' || p_brand), 1, 24) AS title,
      CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 12) WHEN p_partkey % 4 = 1 THEN 'passed' WHEN p_partkey % 4 = 3 THEN 'pending' ELSE '' END AS text FROM part""",
)
def issue_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    level = F.element_at(F.array(*map(F.lit, (" High", "OK", "warning", "?"))), (k % 4 + 1).cast("int"))
    return O.normal_issues(table(spark, sf_dir, "part").select(k.alias("issue_id"), level.alias("level"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"), F.when(k % 3 == 0, F.col("p_name")).otherwise(" ").alias("text")))


@register(
    "chunk_process_merge",
    f"""WITH {LINES}, c AS (SELECT table_id AS run_id, row_index AS ord, flag AS text, part AS b, CASE WHEN row_index % 3 = 1 THEN 's' || row_index END AS s, CASE WHEN flag = 'N' THEN 'analysis' ELSE 'transform' END AS kind FROM lines),
      t AS (SELECT run_id, string_agg(text, chr(10) || chr(10) ORDER BY o) AS text FROM (SELECT run_id, text, min(ord) AS o FROM c GROUP BY 1, 2) GROUP BY 1),
      p AS (SELECT run_id, string_agg(b, '|' ORDER BY o) AS bullets FROM (SELECT run_id, b, min(ord) AS o FROM c GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY min(ord)) <= 12) GROUP BY 1)
      SELECT run_id, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE any_value(kind) END AS kind, coalesce(arg_min(s, ord) FILTER (s IS NOT NULL), '') AS summary, any_value(t.text) AS text, any_value(bullets) AS bullets FROM c JOIN t USING (run_id) JOIN p USING (run_id) GROUP BY run_id""",
)
def chunk_process_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("row_index")
    chunks = lines(spark, sf_dir).select(F.col("table_id").alias("run_id"), r.alias("ord"), F.when(F.col("flag") == "N", "analysis").otherwise("transform").alias("kind"), F.col("flag").alias("text"), F.when(r % 3 == 1, F.concat(F.lit("s"), r.cast("string"))).otherwise("").alias("summary"), F.array(F.col("part"), F.lit(" ")).alias("bullets"))
    return O.merged_process(chunks)


@register(
    "chunk_merge",
    f"""WITH {LINES}, c AS (SELECT table_id AS run_id, row_index % 2 AS prompt, flag AS label, row_index AS ord, CASE WHEN row_index % 5 = 0 THEN '' ELSE shipped[1:4] END AS value FROM lines),
      m AS (SELECT run_id, prompt, label, min(ord) AS o, coalesce(arg_min(value, ord) FILTER (value <> ''), '') AS value, count(DISTINCT nullif(value, '')) > 1 AS conflict FROM c GROUP BY 1, 2, 3)
      SELECT run_id, prompt, CAST(row_number() OVER (PARTITION BY run_id, prompt ORDER BY o, label) AS INT) AS place, label, value, conflict FROM m""",
)
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("row_index")
    chunks = lines(spark, sf_dir).select(F.col("table_id").alias("run_id"), (r % 2).alias("prompt"), F.col("flag").alias("label"), r.alias("ord"), F.when(r % 5 == 0, " ").otherwise(F.substring("shipped", 1, 4)).alias("value"))
    return O.merged_extraction(chunks)


@register(
    "parser_precedence",
    """WITH p AS (SELECT p_partkey AS k, p_size % 4 AS n FROM part WHERE p_partkey % 5 <> 0), m AS (SELECT p_partkey AS k, p_size % 3 AS n, p_partkey % 2 = 0 AS pref FROM part WHERE p_partkey % 7 <> 0)
      SELECT coalesce(p.k, m.k) AS block_id, CASE WHEN ((m.pref AND m.n > 0) OR coalesce(p.n, 0) = 0) AND coalesce(m.n, 0) > 0 THEN 'model' WHEN p.n > 0 THEN 'parser' ELSE 'none' END AS source,
        CASE WHEN ((m.pref AND m.n > 0) OR coalesce(p.n, 0) = 0) AND coalesce(m.n, 0) > 0 THEN m.n ELSE coalesce(p.n, 0) END AS rows, CASE WHEN p.k IS NULL THEN 'a,m' WHEN m.k IS NULL THEN 'a,p' ELSE 'a,p,m' END AS pairs FROM p FULL JOIN m ON p.k = m.k""",
)
def parser_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    parser = p.where(k % 5 != 0).select(k.alias("block_id"), (F.col("p_size") % 4).alias("rows"), F.array(F.lit("a"), F.lit("p")).alias("pairs"))
    model = p.where(k % 7 != 0).select(k.alias("block_id"), (F.col("p_size") % 3).alias("rows"), F.array(F.lit("a"), F.lit("m")).alias("pairs"), (k % 2 == 0).alias("preferred"))
    return O.preferred_tables(parser, model)


@register("scope_move", "SELECT CASE WHEN c_custkey % 10 = 0 AND c_custkey % 20 <> 0 THEN 'b' WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS scope, CASE WHEN c_custkey % 20 = 0 THEN c_custkey ELSE c_custkey END AS item FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 10 <> 0 UNION ALL SELECT 'b', c_custkey FROM customer WHERE c_custkey % 20 = 0 AND c_custkey % 3 <> 0")
def scope_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer moves to another scope, unless one of its name is there."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").where((k % 3 != 0) | (k % 10 != 0))
    rows = c.select(F.when(k % 3 == 0, "b").otherwise("a").alias("scope"), k.alias("item")).unionByName(c.where((k % 20 == 0) & (k % 3 != 0)).select(F.lit("b").alias("scope"), k.alias("item")))
    moves = c.where((k % 10 == 0) & (k % 3 != 0)).select(F.lit("a").alias("scope"), k.alias("item"), F.lit("b").alias("new_scope"))
    return O.moved(rows, moves, ["scope", "item"])[0]


@register(
    "label_coverage",
    f"""WITH {LINES}, e AS (SELECT table_id AS group_id, list_sort(list_distinct(list(flag))) AS e FROM lines WHERE row_index % 2 = 0 GROUP BY 1), a AS (SELECT table_id AS group_id, list_sort(list_distinct(list(flag))) AS a FROM lines WHERE row_index % 2 = 1 GROUP BY 1)
      SELECT group_id, CAST(len(list_intersect(coalesce(e, []), coalesce(a, []))) AS INT) AS covered, array_to_string(list_filter(coalesce(e, []), lambda x: NOT list_contains(coalesce(a, []), x)), ',') AS missing, array_to_string(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(e, []), x)), ',') AS extra FROM e FULL JOIN a USING (group_id)""",
)
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.col("table_id").alias("group_id"), "row_index", F.col("flag").alias("label"))
    return O.label_coverage(rows.where("row_index % 2 = 0"), rows.where("row_index % 2 = 1"))


@register(
    "output_overviews",
    f"""WITH {LINES}, e AS (SELECT table_id AS run_id, string_agg(part, '|' ORDER BY row_index) AS errors FROM lines WHERE flag = 'R' GROUP BY 1)
      SELECT r.run_id, CAST(field_list AS BIGINT) AS field_list, CAST(data_table AS BIGINT) AS data_table, 0 AS kv_table, 0 AS kv_record_table, CAST(record_collection AS BIGINT) AS record_collection, CAST(custom AS BIGINT) AS custom, coalesce(errors, '') AS errors
      FROM (SELECT run_id, max(f) AS field_list, max(CASE WHEN t AND run_id % 3 = 1 THEN 1 ELSE 0 END) AS data_table, max(CASE WHEN t AND run_id % 3 = 0 THEN 1 ELSE 0 END) AS record_collection, max(CASE WHEN t AND run_id % 3 = 2 THEN 1 ELSE 0 END) AS custom
        FROM (SELECT o_orderkey AS run_id, 1 AS f, false AS t FROM orders UNION ALL SELECT DISTINCT table_id, 0, true FROM lines) GROUP BY 1) r LEFT JOIN e USING (run_id)""",
)
def output_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = lines(spark, sf_dir).where("flag = 'R'").select(F.col("table_id").alias("run_id"), F.col("row_index").alias("ord"), F.col("part").alias("error"))
    return O.overviews(O.normalised(raw_outputs(spark, sf_dir)), errors)


@register(
    "table_high_cost",
    f"""WITH {LINES}, t AS (SELECT table_id, count(*) AS n FROM lines GROUP BY 1), d AS (SELECT table_id // 8 AS doc_id, sum(n) AS rows, sum(n * CASE WHEN table_id % 3 = 0 THEN 1 ELSE 6 END) AS cells, count(DISTINCT table_id % 4) AS pages, max(table_id % 6100) AS text FROM t GROUP BY 1)
      SELECT doc_id, CAST(rows AS BIGINT) AS rows, CAST(cells AS BIGINT) AS cells, pages, rows >= 80 OR cells >= 500 OR pages >= 3 OR text >= 6000 AS costly FROM d""",
)
def table_high_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("table_id")
    made = lines(spark, sf_dir).groupBy("table_id").agg(F.count("*").alias("rows"))
    return T.high_cost(made.select(F.floor(t / 8).alias("doc_id"), (t % 4).alias("page_no"), "rows", F.when(t % 3 == 0, 0).otherwise(6).alias("columns"), (t % 6100).alias("text_length")))


@register(
    "prompt_table_target",
    """WITH b AS (SELECT p_size AS prompt_id, p_partkey AS block_id, list_distinct(list_transform(string_split(p_name || ' ' || p_type, ' '), lambda w: lower(regexp_replace(w, '[^0-9a-zA-Z]+', '', 'g')))) AS w FROM part),
      f AS (SELECT * FROM (SELECT DISTINCT p_size AS prompt_id FROM part), (SELECT unnest(['promo', 'size', 'green']) AS field, unnest(['standard', 'small', 'red']) AS alias)),
      s AS (SELECT b.prompt_id, block_id, CAST(count(*) FILTER (list_contains(w, field) OR list_contains(w, alias)) AS BIGINT) AS score FROM b JOIN f USING (prompt_id) GROUP BY 1, 2),
      r AS (SELECT *, max(score) OVER (PARTITION BY prompt_id) AS best, count(*) OVER (PARTITION BY prompt_id) AS n FROM s)
      SELECT prompt_id, block_id, score FROM r WHERE n = 1 OR (prompt_id % 2 = 0 AND score = best AND best >= 2) OR (prompt_id % 2 = 1 AND (score = best OR best <= 0))""",
)
def prompt_table_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "part").select(F.col("p_size").alias("prompt_id"), F.col("p_partkey").alias("block_id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("words"))
    asked = blocks.select("prompt_id").distinct()
    pairs = F.array(*[F.struct(F.lit(a).alias("field"), F.array(F.lit(b)).alias("aliases")) for a, b in (("Promo", "standard"), ("size", "SMALL"), ("green", "red"))])
    fields = asked.select("prompt_id", F.inline(pairs))
    return T.target_blocks(T.field_scores(blocks, fields), asked.withColumn("named", F.col("prompt_id") % 2 == 0))


@register(
    "prompt_header_choice",
    f"""WITH {LINES}, c AS (SELECT table_id, row_index AS ord, CASE WHEN flag = 'R' THEN 4 ELSE 2 END AS w, CASE WHEN flag = 'R' THEN 3 WHEN flag = 'A' THEN 2 ELSE 0 END AS m FROM lines)
      SELECT table_id, m * 100 - w AS score, ord, array_to_string(list_transform(range(w), lambda i: 'h' || i), ',') AS headers FROM c WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY m * 100 - w DESC, ord) = 1""",
)
def prompt_header_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.when(F.col("flag") == "R", 4).otherwise(2)
    headers = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit("h"), i.cast("string")))
    rows = lines(spark, sf_dir).select("table_id", F.col("row_index").alias("ord"), headers.alias("headers"), F.when(F.col("flag") == "R", 3).when(F.col("flag") == "A", 2).otherwise(0).alias("matched"))
    return T.chosen_headers(rows).withColumn("headers", F.array_join("headers", ","))


@register(
    "table_display_choice",
    """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'line' AS source, CASE WHEN 3 >= greatest(1, (n + 1) // 2) THEN 'grid' ELSE 'records' END AS shown, count(*) AS tables FROM n GROUP BY ALL UNION ALL SELECT 'kv', 'grid', count(*) FROM orders""",
)
def table_display_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, made in (("line", line_tables(spark, sf_dir)), ("kv", kv_tables(spark, sf_dir))):
        found = T.display_views(H.grids(made)).withColumn("source", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("source", "shown").agg(F.count("*").alias("tables"))


@register(
    "markdown_rows",
    f"""WITH {LINES} SELECT table_id AS id, 0 AS row_no, 'Line;A|B' AS cells FROM (SELECT DISTINCT table_id FROM lines) UNION ALL SELECT table_id, row_index + 1, line || ';' || part FROM lines""",
)
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("| "), "line", F.lit(" | "), "part", F.lit(" |"))
    made = lines(spark, sf_dir).groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", row.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    texts = made.select(F.col("table_id").alias("id"), F.concat(F.lit("Here:\n| Line | A\\|B |\n|---|:---:|\n"), "t", F.lit("\nend |")).alias("markdown"))
    return T.markdown_rows(texts).withColumn("cells", F.array_join("cells", ";"))


@register(
    "table_request_chunks",
    f"""WITH {LINES}, t AS (SELECT *, line || ' | ' || part AS t, lag(line || ' | ' || part) OVER w AS b, lead(line || ' | ' || part) OVER w AS a FROM lines WINDOW w AS (PARTITION BY table_id ORDER BY row_index))
      SELECT table_id, row_index // 3 AS chunk, string_agg(t, chr(10) ORDER BY row_index) AS rows, coalesce(max(b) FILTER (row_index % 3 = 0), '') AS before, coalesce(arg_max_null(a, row_index), '') AS after FROM t GROUP BY 1, 2""",
)
def table_request_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.request_chunks(lines(spark, sf_dir).select("table_id", "row_index", F.array("line", "part").alias("cells")))


@register(
    "row_decision_pairs",
    f"""WITH {LINES}, c AS (SELECT table_id AS group_id, row_index + 1 AS ord, part AS anchor, CASE WHEN row_index % 4 = 3 THEN 'skip' ELSE 'keep' END AS decision, row_index % 4 AS k, * FROM lines),
      p AS (SELECT group_id, ord, 0 AS i, anchor, 'Flag' AS key, flag AS value FROM c WHERE k = 0 UNION ALL SELECT group_id, ord, unnest([0, 1]), anchor, unnest(['Price', 'Day']), unnest([price, shipped]) FROM c WHERE k = 1 UNION ALL SELECT group_id, ord, 0, anchor, 'Label', price FROM c WHERE k = 2),
      f AS (SELECT group_id, key, value, anchor, min(row(ord, i)) AS o FROM p GROUP BY ALL)
      SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY o) AS INT) AS place, key, value, anchor FROM f""",
)
def row_decision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own pairs, cells by turns and a label with one value, by turns; every fourth line is skipped."""
    r = F.col("row_index")
    held = lines(spark, sf_dir)
    pairs = F.when(r % 4 == 0, F.array(F.struct(F.lit("Flag:").alias("key"), F.col("flag").alias("value")), F.struct(F.lit("none").alias("key"), F.lit(" ").alias("value"))))
    decisions = held.select(F.col("table_id").alias("group_id"), (r + 1).alias("ord"), F.when(r % 4 == 3, "skip").otherwise("keep").alias("decision"), F.col("part").alias("anchor"), (r + 1).alias("row_index"), pairs.alias("pairs"), F.lit("Label：").alias("label"), F.array(F.col("price"), F.lit("")).alias("values"))
    cells = F.when(r % 4 == 1, F.array(F.lit("Price:"), F.col("price"), F.lit(""), F.lit("Day"), F.col("shipped"))).otherwise(F.array(F.lit("12"), F.col("price")))
    rows = held.select(F.col("table_id").alias("group_id"), F.lit("").alias("anchor"), (r + 1).alias("row_index"), cells.alias("cells"))
    return O.decision_pairs(decisions, rows)


@register("result_kinds", "SELECT p_partkey AS result_id, CASE p_partkey % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'text' WHEN 2 THEN 'decision' WHEN 3 THEN 'object' WHEN 4 THEN '' ELSE 'text' END AS result_kind FROM part")
def result_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    one = lambda *parts: F.create_map(*[F.lit(x) for x in parts])
    body = F.when(k == 0, one("headers", "[1]", "rows", "[]")).when(k == 1, one("text", "x")).when(k == 2, one("decision", "y", "text", "x", "more", "z")).when(k == 3, one("headers", "h", "rows", "[]")).when(k == 4, F.create_map().cast("map<string,string>")).otherwise(one("decision", "x", "a", "b", "c", "d"))
    return O.result_kinds(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("result_id"), F.when(k == 5, " text ").otherwise("odd").alias("said"), body.alias("body")))


@register(
    "payload_metrics",
    f"""WITH {LINES}, f AS (SELECT table_id // 5 AS doc_id, table_id AS page_no, row_index AS block_no, CASE WHEN flag <> 'N' THEN row_index + 1 END AS rows FROM lines), s AS (SELECT doc_id, count(DISTINCT page_no) AS pages, count(*) AS blocks, count(rows) AS tables, sum(rows) AS rows, max(rows) AS most FROM f WHERE block_no % 2 = 1 GROUP BY 1)
      SELECT f.doc_id, CAST(coalesce(sum(f.rows), 0) AS BIGINT) AS full_rows, coalesce(any_value(pages), 0) AS pages, coalesce(any_value(blocks), 0) AS blocks, coalesce(any_value(tables), 0) AS tables, CAST(coalesce(any_value(s.rows), 0) AS BIGINT) AS rows, coalesce(any_value(most), 0) AS most FROM f LEFT JOIN s USING (doc_id) GROUP BY 1""",
)
def payload_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = lines(spark, sf_dir).select(F.floor(F.col("table_id") / 5).alias("doc_id"), F.col("table_id").alias("page_no"), F.col("row_index").alias("block_no"), F.when(F.col("flag") != "N", F.col("row_index") + 1).alias("rows"))
    return O.payload_metrics(facts, facts.where("block_no % 2 = 1"))
