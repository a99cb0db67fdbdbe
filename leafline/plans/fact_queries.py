"""Queries over facts joined with evidence, rows, runs and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions.text import field_key
from leafline.operators import facts as J
from leafline.plans.adapters import LINES, lines
from leafline.registry import register
from leafline.session import table


@register(
    "evidence_refs",
    """WITH r AS (SELECT o_orderkey AS item_id, unnest([1, 2]) AS ord, unnest([o_custkey, o_custkey + 1]) AS block_id, o_orderstatus AS fallback FROM orders), b AS (SELECT c_custkey AS block_id, c_nationkey + 1 AS page_no, c_name FROM customer WHERE c_custkey % 4 = 0),
      f AS (SELECT item_id, ord, page_no, CAST(b.block_id AS VARCHAR) AS block_id, 'p' || b.block_id AS position, CASE WHEN b.block_id % 8 = 0 THEN c_name ELSE fallback END AS excerpt FROM r JOIN b USING (block_id))
      SELECT * FROM f UNION ALL SELECT item_id, 0, (SELECT min(page_no) FROM b), '', '', any_value(fallback) FROM r WHERE item_id NOT IN (SELECT item_id FROM f) GROUP BY item_id""",
)
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 4 = 0")
    refs = o.select(F.col("o_orderkey").alias("item_id"), F.posexplode(F.array("o_custkey", F.col("o_custkey") + 1)).alias("p", "b"), F.col("o_orderstatus").alias("fallback"))
    refs = refs.select("item_id", (F.col("p") + 1).cast("long").alias("ord"), F.col("b").cast("string").alias("block_id"), "fallback")
    k = F.col("c_custkey")
    blocks = c.select(k.cast("string").alias("block_id"), (F.col("c_nationkey") + 1).alias("page_no"), F.concat(F.lit("p"), k.cast("string")).alias("position"), F.lit("").alias("content"), F.when(k % 8 == 0, F.col("c_name")).alias("title"))
    return J.hydrated_refs(refs, blocks, blocks.select("page_no"))


@register(
    "fact_evidence",
    f"""WITH {LINES} SELECT table_id AS page_no, row_index AS fact_index, part, CASE WHEN row_index % 2 = 0 THEN 'e' || table_id || '-' || row_index || CASE WHEN row_index % 4 = 0 THEN '-b' ELSE '-a' END END AS evidence_id FROM lines""",
)
def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lines(spark, sf_dir).select(F.col("table_id").alias("page_no"), F.col("row_index").alias("fact_index"), "part")
    name = F.concat_ws("-", F.concat(F.lit("e"), F.col("page_no").cast("string")), F.col("fact_index").cast("string"))
    a = held.where("fact_index % 2 = 0").select("page_no", "fact_index", F.lit(1).alias("ord"), F.concat(name, F.lit("-a")).alias("evidence_id"))
    b = held.where("fact_index % 4 = 0").select("page_no", "fact_index", F.lit(2).alias("ord"), F.concat(name, F.lit("-b")).alias("evidence_id"))
    return J.with_evidence(held, a.unionByName(b))


@register(
    "preview_tables",
    f"""WITH {LINES}, t AS (SELECT table_id // 7 AS doc_id, table_id, row_index FROM lines), k AS (SELECT DISTINCT doc_id, CASE doc_id % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'id' ELSE 'all' END AS how FROM t)
      SELECT doc_id, table_id AS page_no, row_index AS fact_index, 'b' || table_id || '-' || row_index AS block_id FROM t JOIN k USING (doc_id) WHERE how = 'all' OR (how = 'index' AND row_index = 0) OR (how = 'id' AND row_index = 0)""",
)
def preview_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews that know the index, only an id, or neither."""
    t = lines(spark, sf_dir).select(F.floor(F.col("table_id") / 7).alias("doc_id"), F.col("table_id").alias("page_no"), F.col("row_index").alias("fact_index"), F.concat(F.lit("b"), F.col("table_id").cast("string"), F.lit("-"), F.col("row_index").cast("string")).alias("block_id"), F.lit("").alias("ordinal"))
    way = F.col("doc_id") % 3
    preview = t.where("fact_index = 0").select("doc_id", "page_no", F.when(way == 0, F.col("fact_index")).otherwise(-9).alias("fact_index"), F.when(way == 2, "").otherwise(F.lit("?")).alias("block_id"), F.when(way == 1, F.col("block_id")).otherwise("").alias("ordinal"))
    return J.previewed(t, preview).select("doc_id", "page_no", "fact_index", "block_id")


@register(
    "row_decisions",
    f"""WITH {LINES} SELECT table_id AS group_id, row_index, part AS anchor, CASE WHEN row_index % 3 = 0 THEN 'keep' WHEN row_index % 3 = 1 THEN 'drop' END AS decision, CASE WHEN row_index % 3 = 0 THEN 'anchor' WHEN row_index % 3 = 1 THEN 'index' ELSE 'none' END AS how
      FROM (SELECT *, count(*) OVER (PARTITION BY table_id, part) AS c FROM lines) WHERE c = 1""",
)
def row_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = lines(spark, sf_dir).withColumn("c", F.count("*").over(Window.partitionBy("table_id", "part"))).where("c = 1").select(F.col("table_id").alias("group_id"), "row_index", F.col("part").alias("anchor"))
    r = F.col("row_index")
    a = rows.where(r % 3 == 0).select("group_id", "anchor", F.lit(None).cast("long").alias("row_index"), F.lit("keep").alias("decision"), F.lit(1).alias("decision_no"))
    b = rows.where(r % 3 == 1).select("group_id", F.lit("").alias("anchor"), "row_index", F.lit("drop").alias("decision"), F.lit(2).alias("decision_no"))
    late = rows.where(r % 3 == 0).select("group_id", "anchor", "row_index", F.lit("late").alias("decision"), F.lit(3).alias("decision_no"))
    return J.decided_rows(rows, a.unionByName(b).unionByName(late))


@register("target_evidence", "SELECT o_orderkey AS target_id, place, block_id, 'e' || block_id AS evidence_id FROM (SELECT o_orderkey, unnest([0, 1]) AS place, unnest([o_custkey, o_orderkey % 50]) AS block_id FROM orders) JOIN customer ON c_custkey = block_id AND c_custkey % 2 = 0")
def target_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target_id"), F.array(F.col("o_custkey"), F.col("o_orderkey") % 50).alias("block_ids"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("block_id"), F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("evidence_id"))
    return J.target_evidence(targets, known)


@register(
    "upstream_chain",
    """WITH u AS (SELECT c_custkey AS run_id, o_orderkey AS up, o_orderpriority AS s FROM customer JOIN orders ON o_custkey = c_custkey), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY up DESC) <= 5)
      SELECT run_id, string_agg(s, chr(10) ORDER BY up) AS context, count(*) AS steps FROM k GROUP BY 1""",
)
def upstream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("summary"))
    met = table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("run_id"), F.col("o_orderkey").alias("upstream_id"), F.col("o_orderkey").alias("ord"))
    return J.chained(runs, met)


@register(
    "target_objects",
    f"""WITH {LINES}, t AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'note' ELSE 'table:3:' || (o_orderkey % 3) END AS target_id, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey % 3 END AS place FROM orders)
      SELECT doc_id, target_id, CAST(place AS INT) AS place, part AS object_id FROM t LEFT JOIN lines ON table_id = doc_id AND row_index = place""",
)
def target_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    targets = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.when(k % 4 == 0, "note").otherwise(F.concat(F.lit("table:3:"), (k % 3).cast("string"))).alias("target_id"))
    objects = lines(spark, sf_dir).select(F.col("table_id").alias("doc_id"), F.col("row_index").cast("int").alias("place"), F.col("part").alias("object_id"))
    return J.target_objects(targets, objects)


@register(
    "run_outputs",
    f"""WITH {LINES} SELECT o_orderkey AS run_id, coalesce(string_agg('s' || row_index, ',' ORDER BY row_index), '') AS steps, coalesce(string_agg(part, ',' ORDER BY row_index) FILTER (flag <> 'N'), '') AS outputs FROM orders LEFT JOIN lines ON table_id = o_orderkey GROUP BY 1""",
)
def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.col("table_id").alias("run_id"), F.col("row_index").alias("step_no"), F.concat(F.lit("s"), F.col("row_index").cast("string")).alias("step_id"), F.col("part").alias("output_id"), (F.col("flag") != "N").alias("final"))
    return J.run_outputs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")), rows.select("run_id", "step_no", "step_id"), rows.select("run_id", "step_no", "output_id", "final"))


@register(
    "candidate_union",
    """WITH a AS (SELECT p_size AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'tree' ELSE 'page_block' END AS source, p_partkey % 90 AS node_id, p_partkey % 12 AS page_no, CAST(floor(p_retailprice) AS BIGINT) % 100 AS score FROM part),
      b AS (SELECT query_id, source, node_id, arg_max(page_no, row(score, -page_no)) AS page_no, max(score) AS score FROM a GROUP BY 1, 2, 3)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_no, node_id DESC, source) AS INT) AS place, source, node_id, page_no, score FROM b""",
)
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    both = table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), F.when(k % 3 == 0, "tree").otherwise("").alias("source"), (k % 90).alias("node_id"), (k % 12).alias("page_no"), (F.col("p_retailprice").cast("long") % 100).alias("score"))
    return J.candidate_union(both.where("source = 'tree'"), both.where("source <> 'tree'"))


@register(
    "requested_fields",
    """WITH b AS (SELECT o_custkey AS group_id, 0 AS part, o_orderkey AS ord, o_orderpriority AS name FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, 1, o_orderkey, upper(o_orderpriority) || ' ' FROM orders WHERE o_orderkey % 2 = 1),
      f AS (SELECT group_id, regexp_replace(lower(name), '[\\s_\\-:：]+', '', 'g') AS k, min(row(part, ord, name)) AS o FROM b GROUP BY 1, 2)
      SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY o) AS INT) AS place, o[3] AS name FROM f""",
)
def requested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("name"))
    return J.requested_fields(o.where("ord % 2 = 0"), o.where("ord % 2 = 1").withColumn("name", F.concat(F.upper("name"), F.lit(" "))), field_key(F.col("name")))
