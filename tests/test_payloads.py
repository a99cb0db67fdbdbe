"""Payloads, bundles, exports, trees and the locator on written-out cases."""

import zipfile

import pytest
from pyspark.sql import functions as F

from leafline.functions import predicates as X
from leafline.operators import export, facts, locator, outputs, payloads, prompt_tables, treebuild
from leafline.sources import bundles


def one(spark, column, kind="string", value=None):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "wanted"),
    [('"a  b"', "a b"), ('["a", ["b", {"text": "c"}], 3]', "a b c"), ('{"content": "", "text": {"item_content": ["x", "", "y"]}}', "x y"), ("plain <|txt_split|> text", "plain text"), (None, ""), ("", "")],
)
def test_flat_text(spark, value, wanted):
    assert one(spark, payloads.flat_text, value=value) == wanted


@pytest.mark.parametrize(
    ("cells", "detail", "context", "business", "skipped"),
    [
        (["1", "a", "b"], True, False, True, False),
        (["2.0", "a", "b"], True, False, False, False),
        (["x", "a", "b"], False, True, False, False),
        ([" ", None, ""], False, False, False, True),
        (["same", "same", "same", "b"], False, True, False, True),
        (["a1", "b2", "c"], False, True, True, False),
        ([], False, False, False, True),
    ],
)
def test_rows(spark, cells, detail, context, business, skipped):
    for function, wanted in ((X.detail_row, detail), (X.context_row, context), (X.business_row, business), (X.skipped_row, skipped)):
        assert one(spark, function, "array<string>", cells) is wanted, function


def test_blocking_and_markup(spark):
    assert one(spark, X.blocking, "array<string>", ["ok", "第 2 页空表格"]) is True
    assert one(spark, X.blocking, "array<string>", ["fine", None]) is False
    assert [one(spark, X.raw_markup, value=v) for v in ("a <TABLE>", "DATA:image/png;BASE64,xx", "text", None)] == [True, True, False, False]


def test_boxes_and_pages(spark):
    assert one(spark, lambda v: payloads.page_of(v, F.lit(4)), value='{"page_idx": 0}') == 1
    assert one(spark, lambda v: payloads.page_of(v, F.lit(4)), value='{"page_no": true, "page": 0}') == 5
    assert one(spark, payloads.box_of, value='{"bbox": [1, "2.5", 3, 4, 9]}') == [1.0, 2.5, 3.0, 4.0]
    assert one(spark, lambda v: payloads.box_of(v, pad=True), value='{"bbox": [1, 2]}') == [0.0] * 4


def test_bundles(spark, tmp_path):
    for name, members in (("a", {"x/full.md": "# t", "x/content_list.json": "[1]", "x/content_list_v2.json": "[2]", "x/image.png": "no"}), ("b", {"model.json": "{}", "y_content_list.json": "[3]"})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as bundle:
            for member, text in members.items():
                bundle.writestr(member, text)
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    found = bundles.chosen_members(bundles.bundle_members(spark, str(tmp_path))).collect()
    assert {(r["bundle"].rsplit("/", 1)[1], r["kind"], r["text"]) for r in found} == {("a.zip", "markdown", "# t"), ("a.zip", "content_list", "[2]"), ("b.zip", "model", "{}"), ("b.zip", "content_list", "[3]")}


def test_states_and_trees_are_read_as_written(spark, tmp_path):
    schema = "id long, note string, task string"
    rows = spark.createDataFrame([(1, "a", "t1"), (2, None, "t2")], schema)
    bundles.write_states(rows, f"{tmp_path}/s", "task")
    bundles.write_states(spark.createDataFrame([(3, "c", "t2")], schema), f"{tmp_path}/s", "task")
    assert sorted(tuple(r) for r in bundles.read_states(spark, f"{tmp_path}/s", schema).collect()) == [(1, "a", "t1"), (3, "c", "t2")]
    nodes = spark.createDataFrame([(1, "x")], "ord long, title string")
    bundles.write_tree(nodes, nodes, nodes, f"{tmp_path}/t")
    assert bundles.read_tree(spark, f"{tmp_path}/t", {"nodes": "ord long, title string"})["nodes"].collect() == nodes.collect()


def test_segments(spark):
    found = bundles.segments(spark.createDataFrame([(1, "intro\nline\n\n<table><tr><td>a\n\nb</td></tr></table>end\n \n\nlast")], "id long, text string"), "id", "text")
    assert [(r["kind"], r["text"][:6]) for r in found.orderBy("ord").collect()][0] == ("text", "intro\n")
    assert [r["kind"] for r in found.where("kind = 'table'").collect()] == ["table"]


def test_export_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, {"a": 'x "q", y', "b": ""}), (1, 2, {"b": "2"})], "doc_id long, row_no int, values map<string,string>")
    export.write_export(rows, ["a", "b"], f"{tmp_path}/e")
    found = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/e").fillna("")
    assert sorted(tuple(r) for r in found.collect()) == [("", "2"), ('x "q", y', "")]
    with pytest.raises(ValueError):
        export.dispatched(rows, "http_connector", {})


def test_moves_and_conflicts(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "scope string, item long")
    moves = spark.createDataFrame([("a", 1, "b"), ("a", 2, "b")], "scope string, item long, new_scope string")
    out, conflicts = outputs.moved(rows, moves, ["scope", "item"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", 2), ("b", 1), ("b", 2)]
    assert [tuple(r) for r in conflicts.collect()] == [("a", 2, "b")]


ELEMENT = "doc_id long, ord long, kind string, level int, page long, content string, block_id string, image_of string, title string, html string, x0 double, y0 double, x1 double, y1 double"


def element(ord_, kind, content, page=1, level=1, image_of=None, box=(None,) * 4):
    return (1, ord_, kind, level, page, content, f"b{ord_}", image_of, None, "<table>", *box)


def test_tree_of_numbers_marks_and_special_nodes(spark):
    rows = [
        element(1, "text", " before "), element(2, "title", "1 One"), element(3, "text", "body  of one"), element(4, "title", "1.1 Sub"), element(5, "title", "(a) mark"), element(6, "image", "pic", image_of="b3"),
        element(7, "table", "tab"), element(8, "title", "minus", level=-1), element(9, "footer", "f"), element(10, "footer", "f"), element(11, "title", "2 Two"), element(12, "title", "plain"),
    ]
    found = {r["ord"]: (r["kind"], r["title"], r["level"], r["parent_ord"]) for r in treebuild.built(spark.createDataFrame(rows, ELEMENT)).collect()}
    assert found == {
        0: ("text", "文档内容", 1, -1), 2: ("text", "1 One", 1, -1), 4: ("text", "1.1 Sub", 2, 2), 5: ("text", "(a) mark", 3, 4), 6: ("image", "", -1, 2), 7: ("table", "", -1, 5),
        9: ("footer", "Page 1 - footer", -1, -1), 10: ("footer", "Page 1 - footer - 1", -1, -1), 11: ("text", "2 Two", 1, -1), 12: ("text", "plain", 1, -1),
    }
    parts = {r["ord"]: r["content"] for r in treebuild.components(spark.createDataFrame(rows, ELEMENT)).collect()}
    assert parts[0] == "before" and parts[2] == "body of one" and parts[5] == "minus"


def test_levels_by_how_headings_stand(spark):
    middle, left = (400.0, 600.0), (50.0, 300.0)
    rows = [
        element(1, "title", "Centre", box=(middle[0], 10.0, middle[1], 30.0)), element(2, "title", "Left", box=(left[0], 100.0, left[1], 120.0)), element(3, "title", "Left and a much longer subtitle", box=(left[0], 130.0, left[1], 150.0)),
        element(4, "title", "as follows:", box=(left[0], 160.0, left[1], 180.0)), element(5, "title", "Far below", box=(left[0], 400.0, left[1], 420.0)), element(6, "title", "Again centre", box=(middle[0], 430.0, middle[1], 450.0)), element(7, "text", "body", box=(0.0, 500.0, 1000.0, 520.0)),
    ]
    held = treebuild.levelled(treebuild.components(spark.createDataFrame(rows, ELEMENT)))
    assert {r["ord"]: r["level"] for r in held.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 2, 6: 1}


def test_locator_over_tables(spark):
    rows = [["Part list", "", ""], ["No", "Price", "Weight"], ["1", "2.50", "x"], ["2", "3.50", "y"], *[["note", "", ""]] * 12, ["total price", "", ""]]
    frame = spark.createDataFrame([(1, "n1", 0, i, cells) for i, cells in enumerate(rows)], "doc_id long, node_id string, table_no int, row_index long, cells array<string>")
    asked = locator.profiles(spark.createDataFrame([(9, 1, "price list", ["PRICE", "WEIGHT", "no", "数据"], ["refund"], ["table"])], "query_id long, doc_id long, slot string, seeds array<string>, negatives array<string>, expected array<string>"))
    assert [t["term"] for t in asked.first()["terms"]] == ["PRICE", "WEIGHT", "number", "num"]
    found = [(r["start"], r["end"], r["terms"], r["header_like"], r["follows"], r["score"], r["place"]) for r in locator.windows(asked, frame).orderBy("place").collect()]
    assert found == [(0, 6, ["PRICE", "WEIGHT"], True, True, 60, 1), (14, 17, ["PRICE"], False, False, 16, 2)]
    nodes = spark.createDataFrame([(1, "n1", 3, 1, 2, "table", "Price list 2024", "price weight", 17, 3), (1, "n2", 1, 4, 1, "text", "Whole", "price", 0, 0), (1, "n3", 2, 1, 2, "text", "Refund", "refund price", 0, 0)], "doc_id long, node_id string, page_no long, pages int, depth int, kind string, title string, text string, rows int, columns int")
    scores = {r["node_id"]: (r["score"], r["uncertainties"]) for r in locator.recalled(asked, nodes, locator.windows(asked, frame), locator.MODULES).collect()}
    assert scores == {"n1": (98, ""), "n3": (30 - 6 + 8 - 9, "")}
    ranked = locator.ranked(locator.recalled(asked, nodes, None, locator.BLOCKS))
    assert [(r["node_id"], r["place"]) for r in ranked.orderBy("place").collect()] == [("n1", 1), ("n2", 2), ("n3", 3)]
    won = locator.reranked(ranked, spark.createDataFrame([(9, "n3", 91), (9, "none", 99)], "query_id long, node_id string, confidence int"))
    assert [(r["node_id"], r["score"], r["won"]) for r in won.orderBy("place").collect()][0] == ("n3", 91, True)


def test_markdown_and_header_choice(spark):
    found = prompt_tables.markdown_rows(spark.createDataFrame([(1, "x\n| a | b\\|c |\n|---|:-:|\n| 1 |  |\n|| no")], "id long, markdown string")).orderBy("row_no").collect()
    assert [r["cells"] for r in found] == [["a", "b|c"], ["1", ""]]
    candidates = spark.createDataFrame([(1, 0, ["a", "b"], 1), (1, 1, ["c", "d"], 1), (2, 0, ["x"], 0)], "table_id long, ord int, headers array<string>, matched int")
    assert [(r["table_id"], r["score"], r["ord"]) for r in prompt_tables.chosen_headers(candidates).collect()] == [(1, 98, 0)]


def test_target_indices(spark):
    frame = spark.createDataFrame([("table:3:12",), ("table:3:x",), ("structured-object:1:4",), (None,)], "t string")
    assert [r["x"] for r in frame.select(facts.target_index(F.col("t"), "table").alias("x")).collect()] == [12, -1, -1, -1]


def test_roles_close_in_document_order(spark):
    def row(place, node, kind="table", first=1, last=1, path=("a",), headers=(), tokens=(), selected=False, rejected=False, blocked=False):
        return (7, place, node, kind, first, last, list(path), list(headers), list(tokens), selected, rejected, blocked)

    head = ("No", "Part", "Price")
    rows = [
        row(1, "n2", first=2, last=2, headers=head, tokens=("x",), selected=True),
        row(2, "n5", first=9, last=9, headers=("a1", "b1", "c1"), path=("q",), tokens=("z",), selected=True),
        row(3, "n3", first=3, last=3, headers=("no", "part name", "price"), path=("b",)),  # like the primary's
        row(4, "n4", first=4, last=4, headers=head, path=("c",), tokens=("u", "v", "w")),  # next to n3, a continuation by then
        row(5, "n6", kind="text", first=5, last=5, path=("d",), tokens=("u", "v"), rejected=True),  # near n4 with two tokens
        row(6, "n7", first=30, last=30, path=("e",), tokens=("u",), rejected=True),
        row(7, "n8", first=3, last=3, headers=head, path=("f",), blocked=True),
        row(13, "n9", first=3, last=3, headers=head),
    ]
    frame = spark.createDataFrame(rows, "query_id long, place int, node_id string, kind string, first int, last int, path array<string>, headers array<string>, tokens array<string>, selected boolean, rejected boolean, blocked boolean")
    assert {r["node_id"]: r["role"] for r in locator.closed_roles(frame).collect()} == {"n2": "primary", "n5": "related", "n3": "continuation", "n4": "continuation", "n6": "related", "n7": "rejected"}
