"""Reports on samples, tables of facts and their previews."""

from leafline.operators import sample_reports as R

COUNTED = "struct<fields:bigint,records:bigint,rows:bigint,labels:array<string>>"


def reports(spark, *rows):
    names = "sample_id int, kind string, expected_type string, actual_type string, skill_type string, has_skill boolean, errors array<string>, confirmed " + COUNTED + ", actual " + COUNTED
    return {r["sample_id"]: r for r in R.validation_reports(spark.createDataFrame(list(rows), names)).collect()}


def keys(report):
    return [(c["key"], c["status"]) for c in report["checks"]]


def test_reports_of_extractions(spark):
    full = (2, 1, 3, ["b", "a"])
    found = reports(
        spark,
        (1, "extraction", "field_list", " field_list ", "field_list", True, None, full, full),
        (2, None, "field_list", "custom", "custom", True, [" e1 ", "", "e1", "e2"], full, (1, 1, 0, ["c"])),
        (3, "extraction", None, None, None, None, [], None, None),
        (4, "extraction", "custom", "custom", None, True, [], (1, 0, 0, []), full),
        (5, "extraction", "custom", "custom", None, False, [], full, None),
    )
    assert found[1]["status"] == "passed" and keys(found[1]) == [(k, "passed") for k in ("runtime_errors", "output_contract", "fieldCount", "recordCount", "rowCount", "field_labels", "skill_frontmatter_contract")]
    assert found[2]["status"] == "failed" and [k for k, s in keys(found[2]) if s == "failed"] == ["runtime_errors", "output_contract", "fieldCount", "rowCount", "field_labels", "skill_frontmatter_contract"]
    assert found[2]["issues"] == ["e1", "e2", "期望 field_list，实际 custom。", "字段数量少于确认样例：1/2。", "表格行数少于确认样例：0/3。", "字段缺失：a、b", "Skill frontmatter output.type=custom，运行契约=field_list。"]
    assert (found[3]["status"], found[3]["warnings"]) == ("warning", [R.NO_CONTRACT, R.NO_GOLD])
    assert (found[4]["status"], found[4]["warnings"]) == ("warning", [R.NOTHING_TO_COUNT, R.NO_SKILL_TYPE])
    assert (found[5]["status"], keys(found[5])) == ("passed", [("runtime_errors", "passed"), ("output_contract", "passed")])


def test_reports_of_operations(spark):
    full = (2, 1, 3, ["a"])
    found = reports(
        spark,
        (1, "operation", "table", "text", "table", True, [], full, (0, 0, 0, [])),
        (2, "operation", "table", None, "text", True, [], full, None),
        (3, "operation", "", "text", None, True, [f"e{i}" for i in range(9)], None, None),
        (4, "operation", "table", "table", "", True, [], full, full),
    )
    assert keys(found[1]) == [("runtime_errors", "passed"), ("operation_result_kind", "failed"), ("skill_frontmatter_result_kind", "passed")]
    assert found[2]["issues"] == ["Skill frontmatter resultKind=text，运行契约=table。"]
    assert found[3]["issues"] == ["e0", "e1", "e2", "e3", "e4"] and found[3]["warnings"] == [R.NO_GOLD]
    assert found[4]["status"] == "passed" and len(found[4]["checks"]) == 2


def test_tables_of_facts_and_their_previews(spark):
    rows = [(1, 0, [[" ", None], []]), (1, 1, [["a "], [""], ["b", "c"], ["d"], ["e"], ["f"], ["g"]]), (1, 2, [["x"], ["y"], ["z"]]), (1, 3, [["x"], ["y"]]), (2, 0, None), (2, 5, [["q"]] * 4), (3, 1, [])]
    tables = R.fact_tables(spark.createDataFrame(rows, "doc_id int, ord int, rows array<array<string>>"))
    found = {(r["doc_id"], r["ord"]): r for r in R.preview_tables(tables).collect()}
    assert sorted(found) == [(1, 1), (1, 2), (1, 3), (2, 5)]
    assert found[1, 1]["rows"] == [["a"], ["b", "c"], ["d"], ["e"], ["g"]] and found[1, 1]["column_count"] == 2
    assert (found[1, 2]["rows"], found[1, 3]["rows"], found[2, 5]["rows"]) == ([["x"], ["y"], ["z"]], [["x"], ["y"]], [["q"]] * 4)
