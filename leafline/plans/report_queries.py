"""Queries over reports on samples and the tables that previews show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import sample_reports as R
from leafline.registry import register
from leafline.session import table

_TYPES = ("field_list", "data_table", "", "custom")


@register(
    "validation_reports",
    f"""WITH s AS (SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS op, ['field_list', 'data_table', '', 'custom'][o_custkey % 4 + 1] AS want, ['field_list', 'data_table', '', 'custom'][(o_custkey + o_orderkey % 3 // 2) % 4 + 1] AS got, CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE ['field_list', 'data_table', '', 'custom'][(o_custkey + o_orderkey % 7 // 6) % 4 + 1] END AS told, o_orderkey % 3 <> 0 AS skill,
        CASE WHEN o_orderkey % 6 = 0 THEN o_orderpriority || '；' || o_orderstatus ELSE '' END AS err, o_orderkey % 11 <> 0 AS has, o_custkey % 3 AS cf, o_custkey % 5 // 2 AS cr, o_orderkey % 2 AS cw, o_orderkey % 3 AS af, o_orderkey % 5 // 2 AS ar, 1 AS aw, o_custkey % 2 = 0 AS lab, o_orderkey % 9 < 4 AS met, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
      k AS (SELECT *, NOT op AND has AS both_, CASE WHEN want = '' OR want = got THEN 'passed' ELSE 'failed' END AS agree, '期望 ' || CASE WHEN want = '' THEN '未指定' ELSE want END || '，实际 ' || got || '。' AS cmp FROM s),
      c AS (SELECT id, 1 AS i, 'runtime_errors' AS key, CASE WHEN err = '' THEN 'passed' ELSE 'failed' END AS status, '' AS detail FROM k
        UNION ALL SELECT id, 2, 'output_contract', CASE WHEN got = '' THEN 'warning' ELSE agree END, CASE WHEN got = '' THEN '{R.NO_CONTRACT}' ELSE cmp END FROM k WHERE NOT op
        UNION ALL SELECT id, 3, 'operation_result_kind', agree, cmp FROM k WHERE op AND got <> ''
        UNION ALL SELECT id, 4, 'gold_output', 'warning', '{R.NO_GOLD}' FROM k WHERE NOT has
        UNION ALL SELECT id, 5, 'fieldCount', CASE WHEN af >= cf THEN 'passed' ELSE 'failed' END, '字段数量少于确认样例：' || af || '/' || cf || '。' FROM k WHERE both_ AND cf > 0
        UNION ALL SELECT id, 6, 'recordCount', CASE WHEN ar >= cr THEN 'passed' ELSE 'failed' END, '记录数量少于确认样例：' || ar || '/' || cr || '。' FROM k WHERE both_ AND cr > 0
        UNION ALL SELECT id, 7, 'rowCount', 'passed', '' FROM k WHERE both_ AND cw > 0
        UNION ALL SELECT id, 8, 'field_labels', CASE WHEN met THEN 'passed' ELSE 'failed' END, '字段缺失：' || pr || '、' || st FROM k WHERE both_ AND lab
        UNION ALL SELECT id, 10, 'skill_frontmatter_contract', CASE WHEN told = '' THEN 'warning' WHEN told = want THEN 'passed' ELSE 'failed' END, CASE WHEN told = '' THEN '{R.NO_SKILL_TYPE}' ELSE 'Skill frontmatter output.type=' || told || '，运行契约=' || want || '。' END FROM k WHERE NOT op AND skill AND want <> ''
        UNION ALL SELECT id, 11, 'skill_frontmatter_result_kind', CASE WHEN told = want THEN 'passed' ELSE 'failed' END, 'Skill frontmatter resultKind=' || told || '，运行契约=' || want || '。' FROM k WHERE op AND skill AND want <> '' AND told <> ''),
      w AS (SELECT id, i, detail FROM c WHERE status = 'warning' UNION ALL SELECT id, 9, '{R.NOTHING_TO_COUNT}' FROM k WHERE both_ AND NOT lab AND cr = 0 AND cw = 0),
      e AS (SELECT id, -1 AS i, string_split(err, '；')[1] AS detail FROM k WHERE err <> '' UNION ALL SELECT id, 0, string_split(err, '；')[2] FROM k WHERE err <> '' UNION ALL SELECT id, i, detail FROM c WHERE status = 'failed' AND i > 1)
      SELECT k.id AS sample_id, CASE WHEN (SELECT bool_or(status = 'failed') FROM c WHERE c.id = k.id) THEN 'failed' WHEN w.x IS NOT NULL THEN 'warning' ELSE 'passed' END AS status, (SELECT string_agg(key || ':' || status, ',' ORDER BY i) FROM c WHERE c.id = k.id) AS checks, coalesce(e.x, '') AS issues, coalesce(w.x, '') AS warnings
      FROM k LEFT JOIN (SELECT id, string_agg(detail, '|' ORDER BY i) AS x FROM e GROUP BY 1) e ON e.id = k.id LEFT JOIN (SELECT id, string_agg(detail, '|' ORDER BY i) AS x FROM w GROUP BY 1) w ON w.id = k.id""",
)
def validation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples with types, errors and counts from their keys; their labels are the order's priority and status."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = lambda x: F.get(F.array(*map(F.lit, _TYPES)), (x % 4).cast("int"))
    labels = F.array("o_orderstatus", "o_orderpriority")
    none = F.array().cast("array<string>")
    counted = lambda f, r, w, labels: F.struct(f.cast("long").alias("fields"), r.cast("long").alias("records"), w.cast("long").alias("rows"), labels.alias("labels"))
    half = lambda x: F.floor(x % 5 / 2)
    samples = table(spark, sf_dir, "orders").select(
        o.alias("sample_id"), F.when(o % 4 == 0, "operation").otherwise("extraction").alias("kind"), kind(c).alias("expected_type"), kind(c + F.floor(o % 3 / 2)).alias("actual_type"), F.when(o % 5 != 1, kind(c + F.floor(o % 7 / 6))).alias("skill_type"), (o % 3 != 0).alias("has_skill"),
        F.when(o % 6 == 0, F.array("o_orderpriority", F.lit(" "), F.concat(F.lit(" "), "o_orderstatus"))).alias("errors"),
        F.when(o % 11 != 0, counted(c % 3, half(c), o % 2, F.when(c % 2 == 0, labels).otherwise(none))).alias("confirmed"), counted(o % 3, half(o), F.lit(1), F.when(o % 9 < 4, labels).otherwise(none)).alias("actual"),
    )
    found = R.validation_reports(samples)
    checks = F.array_join(F.transform("checks", lambda x: F.concat_ws(":", x["key"], x["status"])), ",")
    return found.select("sample_id", "status", checks.alias("checks"), F.array_join("issues", "|").alias("issues"), F.array_join("warnings", "|").alias("warnings"))


@register(
    "preview_fact_tables",
    """WITH b AS (SELECT conv_id AS doc_id, turn AS ord, [x FOR x IN string_split(text, '.') IF trim(x) <> ''] AS r FROM conversations), t AS (SELECT *, CASE WHEN ord = min(ord) OVER (PARTITION BY doc_id) THEN 4 ELSE 2 END AS n FROM b WHERE len(r) > 0)
      SELECT doc_id, ord, array_to_string([trim(x) FOR x IN list_concat(r[1:n], CASE WHEN len(r) > n THEN r[-1:] ELSE [] END)], '|') AS rows FROM t""",
)
def preview_fact_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tables, a row a sentence."""
    rows = F.transform(F.split("text", r"\."), lambda x: F.array(x))
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), rows.alias("rows"))
    shown = R.preview_tables(R.fact_tables(blocks))
    return shown.select("doc_id", "ord", F.array_join(F.transform("rows", lambda r: r[0]), "|").alias("rows"))
