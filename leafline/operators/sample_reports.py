"""Reports on samples against what was confirmed, and the tables of facts that a preview shows.

A report is one projection of its sample's row: checks that do not apply are
null and go, issues and warnings follow from the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most issues and warnings of a report, errors of a run that it lists, and labels that a detail names.
MOST_LISTED, MOST_ERRORS, MOST_LABELS = 12, 5, 12

#: Rows of a document's first table and of its later ones that a preview shows, each with the last row besides.
FIRST_ROWS, LATER_ROWS = 4, 2

#: What checks are called and say.
RUNTIME, NO_ERRORS = "样例运行错误", "无运行错误。"
CONTRACT, NO_CONTRACT, UNSET = "样例输出协议", "未识别到明确输出协议。", "未指定"
OPERATION_CONTRACT = "处理输出协议"
GOLD, NO_GOLD = "确认样例输出", "尚未提供确认样例输出，无法做 gold 对比。"
SKILL_CONTRACT, NO_SKILL_TYPE = "Skill 输出协议", "Skill frontmatter 未声明 output.type。"
SKILL_OPERATION = "Skill 处理协议"
COUNTS = (("fieldCount", "字段数量", "fields"), ("recordCount", "记录数量", "records"), ("rowCount", "表格行数", "rows"))
LABELS, ALL_LABELS = "字段命名覆盖", "确认样例字段均已覆盖。"
NOTHING_TO_COUNT = "确认样例缺少可量化字段、记录或表格行，验证仅能检查协议。"


def _check(applies: Column, key: str, label: str, status: Column | str, detail: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(applies, F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), as_column(status).alias("status"), as_column(detail).alias("detail")))


def _verdict(good: Column) -> Column:
    return F.when(good, "passed").otherwise("failed")


def validation_reports(samples: DataFrame) -> DataFrame:
    """A report for each sample: ``sample_id, status, checks, issues, warnings``.

    ``samples`` has ``sample_id, kind`` (``operation`` or any other), what was
    expected, came out and is declared as a type (``expected_type, actual_type,
    skill_type``), ``has_skill``, ``errors``, and what was counted of the confirmed
    and the actual output: ``confirmed`` and ``actual``, structs of ``fields,
    records, rows, labels``, null without that output. Null lists are empty and
    null types blank.
    """
    text = lambda name: F.trim(F.coalesce(name, F.lit("")))
    errors = F.slice(F.filter(F.transform(F.coalesce("errors", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, MOST_ERRORS)
    held = samples.select("sample_id", (F.coalesce("kind", F.lit("")) == "operation").alias("op"), text("expected_type").alias("want"), text("actual_type").alias("got"), text("skill_type").alias("told"), F.coalesce("has_skill", F.lit(False)).alias("skill"), errors.alias("errors"), F.col("confirmed").alias("c"), F.col("actual").alias("a"))
    op, want, got, told, c, a = (F.col(x) for x in ("op", "want", "got", "told", "c", "a"))
    same = (want == "") | (want == got)
    compared = F.concat(F.lit("期望 "), F.when(want == "", UNSET).otherwise(want), F.lit("，实际 "), got, F.lit("。"))
    both = ~op & c.isNotNull() & a.isNotNull()
    declared = F.col("skill") & (want != "") & (told != "")

    def count(key: str, label: str, name: str) -> Column:
        least, found = F.coalesce(c[name], F.lit(0)), F.coalesce(a[name], F.lit(0))
        share = F.concat(found.cast("string"), F.lit("/"), least.cast("string"))
        return _check(both & (least > 0), key, label, _verdict(found >= least), F.when(found >= least, share).otherwise(F.concat(F.lit(f"{label}少于确认样例："), share, F.lit("。"))))

    none = F.array().cast("array<string>")
    labels = F.coalesce(c["labels"], none)
    absent = F.array_sort(F.array_except(labels, F.coalesce(a["labels"], none)))
    listed = F.when(F.size(absent) > 0, F.concat(F.lit("字段缺失："), F.array_join(F.slice(absent, 1, MOST_LABELS), "、"))).otherwise(ALL_LABELS)
    skill_says = lambda head: F.concat(F.lit(head), told, F.lit("，运行契约="), want, F.lit("。"))
    checks = [
        _check(F.lit(True), "runtime_errors", RUNTIME, _verdict(F.size("errors") == 0), F.when(F.size("errors") == 0, NO_ERRORS).otherwise(F.array_join("errors", "；"))),
        _check(~op, "output_contract", CONTRACT, F.when(got == "", "warning").otherwise(_verdict(same)), F.when(got == "", NO_CONTRACT).otherwise(compared)),
        _check(op & (got != ""), "operation_result_kind", OPERATION_CONTRACT, _verdict(same), compared),
        _check(c.isNull(), "gold_output", GOLD, "warning", NO_GOLD),
        *[count(*x) for x in COUNTS],
        _check(both & (F.size(labels) > 0), "field_labels", LABELS, _verdict(F.size(absent) == 0), listed),
        _check(~op & F.col("skill") & (want != ""), "skill_frontmatter_contract", SKILL_CONTRACT, F.when(told == "", "warning").otherwise(_verdict(told == want)), F.when(told == "", NO_SKILL_TYPE).otherwise(skill_says("Skill frontmatter output.type="))),
        _check(op & declared, "skill_frontmatter_result_kind", SKILL_OPERATION, _verdict(told == want), skill_says("Skill frontmatter resultKind=")),
    ]
    bare = both & (F.size(labels) == 0) & (F.coalesce(c["records"], F.lit(0)) == 0) & (F.coalesce(c["rows"], F.lit(0)) == 0)
    checked = held.withColumn("checks", F.array_compact(F.array(*checks))).withColumn("bare", bare)
    said = lambda status: F.transform(F.filter("checks", lambda x: (x["status"] == status) & (x["key"] != "runtime_errors")), lambda x: x["detail"])
    # what cannot be counted is said before the skill's own check, which comes last
    skill_last = lambda x: x["key"] == "skill_frontmatter_contract"
    warned = F.filter("checks", lambda x: x["status"] == "warning")
    details = lambda xs: F.transform(xs, lambda x: x["detail"])
    warnings = F.concat(details(F.filter(warned, lambda x: ~skill_last(x))), F.when(F.col("bare"), F.array(F.lit(NOTHING_TO_COUNT))).otherwise(none), details(F.filter(warned, skill_last)))
    any_of = lambda status: F.exists("checks", lambda x: x["status"] == status)
    status = F.when(any_of("failed"), "failed").when(any_of("warning") | F.col("bare"), "warning").otherwise("passed")
    unique = lambda xs: F.slice(F.array_distinct(xs), 1, MOST_LISTED)
    return checked.select("sample_id", status.alias("status"), "checks", unique(F.concat("errors", said("failed"))).alias("issues"), unique(warnings).alias("warnings"))


def fact_tables(blocks: DataFrame) -> DataFrame:
    """Blocks whose grid says something, with rows of trimmed cells: those without any text go, and blocks without rows left.

    ``blocks`` has ``rows``, an array of arrays of texts, null for none. Adds ``column_count``, the widest row's.
    """
    cells = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda x: F.trim(F.coalesce(x, F.lit("")))))
    said = F.filter(cells, lambda r: F.exists(r, lambda x: x != ""))
    held = blocks.withColumn("rows", said).where(F.size("rows") > 0)
    return held.withColumn("column_count", F.array_max(F.transform("rows", lambda r: F.size(r))))


def preview_tables(blocks: DataFrame, first: int = FIRST_ROWS, later: int = LATER_ROWS) -> DataFrame:
    """Blocks with rows, each cut to what a preview shows: the first rows (more for the document's first table) and the last.

    ``blocks`` has ``doc_id, ord`` and ``rows``, an array. Only the least ``ord`` of
    a document is found across rows, by a running minimum without order.
    """
    held = blocks.where(F.size(F.coalesce("rows", F.array())) > 0)
    least = F.min("ord").over(Window.partitionBy("doc_id"))
    most = F.when(F.col("ord") == least, first).otherwise(later)
    n = F.size("rows")
    shown = held.withColumn("_most", most)
    return shown.withColumn("rows", F.concat(F.slice("rows", F.lit(1), F.col("_most")), F.when(n > F.col("_most"), F.slice("rows", -1, 1)).otherwise(F.slice("rows", 1, 0)))).drop("_most")
