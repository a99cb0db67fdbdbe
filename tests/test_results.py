"""Model results and stored records of uncertain shape."""

import json

from leafline.operators import results as R


def answers(spark, *values):
    rows = [(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id int, answer string")


def test_operation_results_name_the_first_fault(spark):
    good = {"summary": " s ", "result_kind": " Object", "output_payload": {"a": 1}}
    given = answers(
        spark, good, None, "", "{", "[1]", "5", {**good, "summary": False}, {**good, "result_kind": "issues"}, {"summary": "s", "resultKind": "text"}, {**good, "result_kind": "text"},
        {**good, "result_kind": "table", "output_payload": {"headers": [], "rows": {}}}, {**good, "result_kind": "decision", "output_payload": []}, {**good, "output_payload": None, "outputPayload": {}},
    )
    found = [r["error"] for r in R.operation_results(given).orderBy("id").collect()]
    assert found == [None, "not_object", "not_object", "not_object", "not_object", "not_object", "no_summary", "bad_kind", "no_output", "bad_output", "bad_output", "bad_output", "bad_output"]


def test_operation_results_keep_lists_and_the_rest(spark):
    given = {"summary": 7, "resultKind": "text", "outputPayload": "", "validation_errors": [f" e{i} " for i in range(25)] + [None], "evidenceRefs": [{"pageNo": 2, "blockId": 5, "excerpt": " x "}, [], {}] * 9, "model": {"b": [1]}}
    r = R.operation_results(answers(spark, given)).first()
    assert (r["summary"], r["result_kind"], r["error"], r["validation_errors"]) == ("7", "text", None, [f"e{i}" for i in range(20)])
    assert len(r["refs"]) == 18 and tuple(r["refs"][0]) == (2, "5", "", "x") and tuple(r["refs"][1]) == (0, "", "", "")
    assert r["rescued"] == {"model": '{"b":[1]}'}


def test_sample_results_take_every_shape(spark):
    given = [
        {"a": 1, "summary": "s", "errors": ["e", " "]},
        {"outputPayload": {"headers": [1], "rows": [], "x": 2}},
        {"result_kind": "table", "output_payload": {"headers": "no", "x": 2}},
        {"resultKind": "text", "outputPayload": "body"},
        {"outputPayload": {"text": "t", "more": 1}},
        {"outputPayload": {"text": "t", "decision": 1, "c": 1}},
        {"outputPayload": None, "validationErrors": "x", "errors": [3]},
        {"resultKind": "list", "outputPayload": [1, 2]},
        None,
    ]
    found = [(r["result_kind"], json.loads(r["output"]), r["validation_errors"]) for r in R.sample_results(answers(spark, *given)).orderBy("id").collect()]
    assert found == [
        ("object", {"a": 1}, ["e"]), ("table", {"headers": [1], "rows": [], "x": 2}, []), ("table", {"headers": [], "rows": [], "x": 2}, []), ("text", {"text": "body"}, []), ("text", {"text": "t", "more": 1}, []),
        ("decision", {"text": "t", "decision": 1, "c": 1}, []), ("object", {}, ["3"]), ("object", [1, 2], []), ("object", {}, []),
    ]


def test_references_of_any_shape(spark):
    refs = [{"page": "4", "text": "a"}, {"pageNo": 0, "source_page": "第 12 页", "block_id": "b"}, {"excerpt": "见第3页。", "original_text": "o"}, {"page": "x"}, "第1页", {"pageNo": 2, "blockId": None, "block_id": 9}]
    found = answers(spark, refs, {"a": 1}).selectExpr("id", "try_parse_json(answer) as v").select("id", R.coerced_references(R.F.col("v")).alias("refs")).orderBy("id").collect()
    assert [tuple(x) for x in found[0]["refs"]] == [(4, "", "", "a"), (12, "b", "", ""), (3, "", "", "见第3页。"), (2, "9", "", "")]
    assert found[1]["refs"] == []


def test_records_with_broken_columns(spark):
    rows = spark.createDataFrame([(1, '[" a ", 2, null, ""]', '{"x": {"y": 1}}', "z"), (2, None, None, "z"), (3, "{}", "[]", "z"), (4, "[", "", "z")], "id int, tags string, config string, rescue string")
    found = {r["id"]: r for r in R.records(rows, ["tags"], ["config"], "rescued").orderBy("id").collect()}
    assert [found[i]["tags"] for i in (1, 2, 3, 4)] == [["a", "2"], [], [], []]
    assert [found[i]["errors"] for i in (1, 2, 3, 4)] == [[], ["tags:null"], ["tags:no_list", "config:no_object"], ["tags:no_json"]]
    assert found[3]["rescued"] == {"tags": "{}", "config": "[]"} and found[1]["rescued"] == {} and found[1]["rescue"] == "z"
    assert found[1]["config"]["x"].toPython() == {"y": 1} and found[4]["config"] == {}
    assert [(r["id"], r["has"]) for r in R.light(rows, ["tags", "config"]).orderBy("id").collect()][:2] == [(1, ["tags", "config"]), (2, [])]


def test_skills_of_customers_come_first(spark):
    skills = spark.createDataFrame(
        [("k", None, "1", "active", "x", 1), ("k", 7, "2", "active", "x", 9), ("k", 7, "3", "active", "bad", 2), ("k", 7, "1", "disabled", "x", 1), ("p", None, "1", "active", "bad", 2), ("p", None, "2", "active", "x", 1)],
        "skill_id string, customer_id int, version string, status string, executor string, place int",
    )
    asked = spark.createDataFrame([(1, "k", 7, None), (2, "k", None, None), (3, "k", 7, "1"), (4, "k", 8, "2"), (5, "p", 7, None), (6, "q", 7, None), (7, None, None, None)], "ask_id int, skill_id string, customer_id int, version string")
    found = {r["ask_id"]: r["found"] and (r["found"]["customer_id"], r["found"]["version"]) for r in R.resolved(asked, skills, ["x"]).collect()}
    assert found == {1: (7, "2"), 2: (None, "1"), 3: (None, "1"), 4: None, 5: (None, "2"), 6: None, 7: None}
