"""Queries over model results, stored records and what questions for skills mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import results as R
from leafline.registry import register
from leafline.session import table

#: A model's answer a document, of twelve shapes.
_ANSWERS = r"""q AS (SELECT doc_id AS id, to_json(coalesce(text, '')) AS t, to_json(coalesce(source, '')) AS s, to_json(lang) AS l FROM documents),
  a AS (SELECT id, id % 12 AS k, CAST(CASE id % 12
    WHEN 0 THEN '{"summary": " x ", "result_kind": "TEXT ", "output_payload": ' || t || ', "validation_errors": [' || coalesce(l, 'null') || ', " ", ' || id || '], "evidence_refs": [{"pageNo": "3", "blockId": " b ", "excerpt": ' || t || '}, "x", {"page": 2}], "extra": ' || id || '}'
    WHEN 1 THEN '{"summary": ' || s || ', "resultKind": "table", "outputPayload": {"headers": ["a"], "rows": [[' || t || ']]}, "validationErrors": "none", "evidenceRefs": null}'
    WHEN 2 THEN '{"summary": "  ", "result_kind": "object", "output_payload": {}}'
    WHEN 3 THEN '{"summary": ' || s || ', "result_kind": "list", "output_payload": [' || t || ']}'
    WHEN 4 THEN '{"summary": ' || s
    WHEN 5 THEN '[' || t || ']'
    WHEN 6 THEN '{"summary": ' || (id + 1) || ', "result_kind": "table", "output_payload": {"headers": ["a"], "rows": ' || t || '}}'
    WHEN 7 THEN '{"summary": ' || s || ', "result_kind": null, "resultKind": "object", "outputPayload": {"text": ' || t || '}}'
    WHEN 8 THEN '{"summary": ' || s || ', "resultKind": "decision", "errors": [' || t || ']}'
    WHEN 9 THEN '{"summary": 0, "resultKind": "object", "outputPayload": {"decision": ' || t || ', "b": 1, "c": 2}, "errors": [1]}'
    WHEN 10 THEN '{"summary": ' || s || ', "resultKind": "decision", "outputPayload": {"a": ' || t || '}, "more": [' || t || ']}' END AS VARCHAR) AS answer FROM q),
  j AS (SELECT *, CASE WHEN json_valid(answer) AND left(answer, 1) = '{' THEN CAST(answer AS JSON) END AS m FROM a)"""


def _quoted(text: Column) -> Column:
    written = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(written, F.lit(2), F.length(written) - 2)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer a document; its text, source and language are in it, and every twelfth is missing."""
    d, t, s, lang = F.col("doc_id"), _quoted(F.col("text")), _quoted(F.col("source")), F.coalesce(F.when(F.col("lang").isNotNull(), _quoted(F.col("lang"))), F.lit("null"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    shapes = [
        text('{"summary": " x ", "result_kind": "TEXT ", "output_payload": ', t, ', "validation_errors": [', lang, ', " ", ', d, '], "evidence_refs": [{"pageNo": "3", "blockId": " b ", "excerpt": ', t, '}, "x", {"page": 2}], "extra": ', d, "}"),
        text('{"summary": ', s, ', "resultKind": "table", "outputPayload": {"headers": ["a"], "rows": [[', t, ']]}, "validationErrors": "none", "evidenceRefs": null}'),
        text('{"summary": "  ", "result_kind": "object", "output_payload": {}}'),
        text('{"summary": ', s, ', "result_kind": "list", "output_payload": [', t, "]}"),
        text('{"summary": ', s),
        text("[", t, "]"),
        text('{"summary": ', d + 1, ', "result_kind": "table", "output_payload": {"headers": ["a"], "rows": ', t, "}}"),
        text('{"summary": ', s, ', "result_kind": null, "resultKind": "object", "outputPayload": {"text": ', t, "}}"),
        text('{"summary": ', s, ', "resultKind": "decision", "errors": [', t, "]}"),
        text('{"summary": 0, "resultKind": "object", "outputPayload": {"decision": ', t, ', "b": 1, "c": 2}, "errors": [1]}'),
        text('{"summary": ', s, ', "resultKind": "decision", "outputPayload": {"a": ', t, '}, "more": [', t, "]}"),
    ]
    answer = F.lit(None).cast("string")
    for k, shape in enumerate(shapes):
        answer = F.when(d % 12 == k, shape).otherwise(answer)
    return table(spark, sf_dir, "documents").select(d.alias("id"), answer.alias("answer"))


_STRIP = r"regexp_replace({0}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"
_SAID = _STRIP.format("coalesce(json_extract_string(m, '$.summary'), '')")


@register(
    "operation_results",
    rf"""WITH {_ANSWERS}, r AS (SELECT id, CASE WHEN k = 9 THEN '' ELSE {_SAID} END AS summary, lower(trim(coalesce(CASE WHEN k = 7 THEN NULL ELSE coalesce(json_extract_string(m, '$.result_kind'), json_extract_string(m, '$.resultKind')) END, ''))) AS result_kind, coalesce(json_extract(m, '$.output_payload'), json_extract(m, '$.outputPayload')) AS o, m FROM j)
      SELECT id, summary, result_kind, CASE WHEN m IS NULL THEN 'not_object' WHEN summary = '' THEN 'no_summary' WHEN result_kind NOT IN ('decision', 'object', 'table', 'text') THEN 'bad_kind' WHEN o IS NULL THEN 'no_output'
          WHEN CASE result_kind WHEN 'text' THEN json_type(o) <> 'VARCHAR' WHEN 'table' THEN json_type(o) <> 'OBJECT' OR json_type(o, '$.headers') <> 'ARRAY' OR json_type(o, '$.rows') <> 'ARRAY' ELSE json_type(o) <> 'OBJECT' END THEN 'bad_output' END AS error,
        coalesce(CASE result_kind WHEN 'text' THEN json_extract_string(o, '$') WHEN 'table' THEN json_extract_string(o, '$.rows[0][0]') END, '') AS said,
        CASE WHEN json_type(m, '$.validation_errors') = 'ARRAY' THEN array_to_string(list_filter([trim(x) FOR x IN json_extract_string(m, '$.validation_errors[*]')], lambda x: x <> ''), '|') ELSE '' END AS errors,
        CASE WHEN json_type(m, '$.evidence_refs') = 'ARRAY' THEN '3:b:' || {_STRIP.format("json_extract_string(m, '$.evidence_refs[0].excerpt')")} || '|0::' ELSE '' END AS refs,
        CASE WHEN m IS NULL THEN NULL ELSE array_to_string(list_sort(list_filter(json_keys(m), lambda x: x IN ('extra', 'errors', 'more'))), '|') END AS rescued FROM r""",
)
def operation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.operation_results(answers(spark, sf_dir))
    said = F.when(F.col("result_kind") == "text", F.try_variant_get("output", "$", "string")).when(F.col("result_kind") == "table", F.try_variant_get("output", "$.rows[0][0]", "string"))
    refs = F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["page_no"].cast("string"), r["block_id"], r["excerpt"])), "|")
    return found.select("id", "summary", "result_kind", "error", F.coalesce(said, F.lit("")).alias("said"), F.coalesce(F.array_join("validation_errors", "|"), F.lit("")).alias("errors"), F.coalesce(refs, F.lit("")).alias("refs"), F.array_join(F.array_sort(F.map_keys("rescued")), "|").alias("rescued"))


@register(
    "sample_results",
    rf"""WITH {_ANSWERS} SELECT id, CASE WHEN m IS NULL OR k IN (2, 9) OR {_SAID} = '' THEN '{R.NO_SUMMARY}' ELSE {_SAID} END AS summary,
        CASE k WHEN 1 THEN 'table' WHEN 6 THEN 'table' WHEN 8 THEN 'decision' WHEN 10 THEN 'decision' ELSE 'object' END AS result_kind,
        CASE k WHEN 0 THEN json_extract_string(m, '$.output_payload') WHEN 1 THEN json_extract_string(m, '$.outputPayload.rows[0][0]') WHEN 3 THEN json_extract_string(m, '$.output_payload[0]') WHEN 7 THEN json_extract_string(m, '$.outputPayload.text') WHEN 9 THEN json_extract_string(m, '$.outputPayload.decision') WHEN 10 THEN json_extract_string(m, '$.outputPayload.a') ELSE '' END AS said,
        CASE k WHEN 0 THEN array_to_string(list_filter([trim(x) FOR x IN json_extract_string(m, '$.validation_errors[*]')], lambda x: x <> ''), '|') WHEN 8 THEN {_STRIP.format("json_extract_string(m, '$.errors[0]')")} WHEN 9 THEN '1' ELSE '' END AS errors FROM j""",
)
def sample_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which member of the output holds the document's text differs by shape; ``said`` is that text."""
    found = R.sample_results(answers(spark, sf_dir))
    o = F.try_parse_json("output")
    said = F.coalesce(*[F.try_variant_get(o, p, "string") for p in ("$.rows[0][0]", "$[0]", "$.text", "$.decision", "$.a")], F.when(F.col("id") % 12 == 0, F.try_variant_get(o, "$", "string")), F.lit(""))
    return found.select("id", "summary", "result_kind", said.alias("said"), F.array_join("validation_errors", "|").alias("errors"))


@register(
    "stored_records",
    """SELECT event_id, CASE WHEN event_id % 5 = 1 THEN [] WHEN event_id % 5 IN (2, 3) THEN [] ELSE [event_type, CAST(user_id AS VARCHAR)] END AS tags, CASE WHEN event_id % 7 IN (1, 2) THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
      concat_ws(',', CASE event_id % 5 WHEN 1 THEN 'tags:null' WHEN 2 THEN 'tags:no_json' WHEN 3 THEN 'tags:no_list' END, CASE event_id % 7 WHEN 2 THEN 'props:no_json' END) AS errors,
      CAST(CASE WHEN event_id % 5 IN (2, 3) THEN 1 ELSE 0 END + CASE WHEN event_id % 7 = 2 THEN 1 ELSE 0 END AS INT) AS rescued FROM events""",
)
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a list of tags and their properties as JSON text, some of it missing, broken or of another shape."""
    e = F.col("event_id")
    tags = F.concat(F.lit('[" '), "event_type", F.lit('", null, " ", '), F.col("user_id").cast("string"), F.lit("]"))
    tags = F.when(e % 5 == 1, F.lit(None)).when(e % 5 == 2, F.substring(tags, 1, 6)).when(e % 5 == 3, F.lit('{"a": 1}')).otherwise(tags)
    props = F.when(e % 7 == 1, "").when(e % 7 == 2, F.substring("props", 1, 3)).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", tags.alias("tags"), props.alias("props"))
    found = R.records(rows, ["tags"], ["props"], "rescued")
    return found.select("event_id", "tags", F.col("props")["k"].try_cast("bigint").alias("k"), F.array_join("errors", ",").alias("errors"), F.size("rescued").alias("rescued"))


@register(
    "skill_resolution",
    """WITH s AS (SELECT 'k' || (p_partkey % 60) AS skill_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 11 END AS customer_id, 'v' || (p_size % 3) AS version, CASE WHEN p_partkey % 4 = 1 THEN 'disabled' ELSE 'active' END AS status, p_brand AS executor, p_partkey AS place FROM part),
      q AS (SELECT o_orderkey AS ask_id, 'k' || (o_orderkey % 64) AS skill_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 13 END AS customer_id, CASE WHEN o_orderkey % 3 = 0 THEN 'v' || (o_custkey % 3) END AS version FROM orders),
      m AS (SELECT q.*, s.customer_id AS owner, s.version AS got, s.executor AS executor, place FROM q JOIN s ON q.skill_id = s.skill_id AND (s.customer_id IS NULL OR s.customer_id = q.customer_id) AND status = 'active' AND (q.version IS NULL OR q.version = s.version) AND (s.customer_id IS NULL OR right(executor, 1) <> '3')),
      b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY owner IS NULL, place) = 1)
      SELECT q.ask_id, q.skill_id, owner, got AS version, executor FROM q LEFT JOIN b USING (ask_id)""",
)
def skill_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, o, c = F.col("p_partkey"), F.col("o_orderkey"), F.col("o_custkey")
    text = lambda head, x: F.concat(F.lit(head), x.cast("string"))
    skills = table(spark, sf_dir, "part").select(text("k", k % 60).alias("skill_id"), F.when(k % 3 != 0, k % 11).alias("customer_id"), text("v", F.col("p_size") % 3).alias("version"), F.when(k % 4 == 1, "disabled").otherwise("active").alias("status"), F.col("p_brand").alias("executor"), k.alias("place"))
    asked = table(spark, sf_dir, "orders").select(o.alias("ask_id"), text("k", o % 64).alias("skill_id"), F.when(o % 5 != 0, c % 13).alias("customer_id"), F.when(o % 3 == 0, text("v", c % 3)).alias("version"))
    allowed = [f"Brand#{i}" for i in range(1, 100) if i % 10 != 3]
    return R.resolved(asked, skills, allowed).select("ask_id", "skill_id", F.col("found.customer_id").alias("owner"), F.col("found.version").alias("version"), F.col("found.executor").alias("executor"))
