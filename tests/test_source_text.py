"""Scopes in document trees, their summaries, source texts and budgets."""

import random

from pyspark.sql import functions as F

from leafline.operators import source_text as S


def test_united_intervals(spark):
    rows = [(1, 1, 3), (1, 2, 2), (1, 4, 6), (1, 9, 9), (1, 9, 12), (2, 5, 4), (2, None, 1), (3, 7, None), (4, 1, 1), (4, 3, 3)]
    spans = spark.createDataFrame(rows, "g int, first int, last int")
    found = lambda touching: sorted(map(tuple, S.united(spans, ["g"], touching).collect()))
    assert found(0) == [(1, 1, 3), (1, 4, 6), (1, 9, 12), (4, 1, 1), (4, 3, 3)]
    assert found(1) == [(1, 1, 6), (1, 9, 12), (4, 1, 1), (4, 3, 3)]


def tree(spark, levels, doc=1):
    rows = [(doc, i, f"n{i}", x) for i, x in enumerate(levels)]
    return spark.createDataFrame(rows, "doc_id int, ord int, node_id string, level int")


def test_scopes_against_a_plain_walk(spark):
    r = random.Random(5)
    levels = [r.randrange(1, 5) for _ in range(40)]
    picks = {q: r.sample(range(40), 4) for q in range(12)}
    chosen = spark.createDataFrame([(q, 1, f"n{i}") for q, ids in picks.items() for i in ids], "query_id int, doc_id int, node_id string")
    found = S.scope_rows(S.placed(tree(spark, levels)), chosen).collect()
    want = set()
    for q, ids in picks.items():
        for i in ids:
            end = next((j for j in range(i + 1, 40) if levels[j] <= levels[i]), 40)
            want |= {(q, f"n{j}", "selected_node" if j in ids else "descendant") for j in range(i, end)}
    assert sorted((x["query_id"], x["node_id"], x["reason"]) for x in found) == sorted(want)


def test_summary_unites_pages_and_blocks(spark):
    # n0 holds n1 and n2; n3 ends it; n4 is apart
    places = S.placed(tree(spark, [1, 2, 3, 1, 2]))
    at = F.col("ord")
    pages = F.when(at == 0, F.array(F.lit(1), F.lit(2))).when(at == 1, F.array(F.lit(3), F.lit(3))).when(at == 4, F.array(F.lit(9), F.lit(9)))
    places = places.withColumns({"first_page": pages[0], "last_page": pages[1], "first_block": at * 2, "last_block": at * 2 + 2})
    chosen = spark.createDataFrame([(1, 1, "n0"), (1, 1, "n1"), (1, 1, "n4"), (1, 1, "n4"), (1, 1, "x"), (2, 1, "x")], "query_id int, doc_id int, node_id string")
    one, two = S.scope_summary(places, chosen).orderBy("query_id").collect()
    assert (one["modules"], one["descendants"], [tuple(p) for p in one["pages"]], one["blocks"], one["boundaries"], one["missing"]) == (4, 1, [(1, 3), (9, 9)], 10, ["n3"], 1)
    assert (two["modules"], two["pages"], two["blocks"], two["boundaries"], two["missing"]) == (0, [], 0, [], 1)


def test_budgets_cut_the_last_piece(spark):
    rows = [(1, i, n) for i, n in enumerate([5, None, 20, 0, 10, 4])] + [(2, 0, 32), (2, 1, 1), (2, 2, None), (3, 0, 33), (4, 0, None)]
    blocks = spark.createDataFrame(rows, "doc_id int, ord int, rows int")
    found = sorted((x["doc_id"], x["ord"], x["kept"], x["cut"]) for x in S.row_budget(blocks).collect())
    assert found == [(1, 0, 5, False), (1, 1, None, False), (1, 2, 20, False), (1, 4, 7, True), (2, 0, 32, False), (2, 2, None, False), (3, 0, 32, True), (4, 0, None, False)]
    plan = S.row_budget(blocks)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def plain_source(parts, most, whole):
    """Texts of ``(node, title, input)`` in order, as one source."""
    out, used = [], 0
    for i, (node, title, text) in enumerate(parts, 1):
        text = text.strip()
        if len(text) > most:
            text = text[:most] + S.MODULE_CUT
        part = f"## 命中模块 {i}：{title.strip() or node}\n{text}".strip()
        if used < whole:
            left = whole - used
            out.append(part if len(part) <= left else part[:left] + S.SOURCE_CUT)
            used += min(left, len(part))
    return "\n\n".join(out).strip()


def test_source_texts_against_a_plain_loop(spark):
    r = random.Random(3)
    docs = {q: [(f"n{i}", r.choice(["", " t ", "标题"]), "" if r.random() < 0.2 else "字 x" * r.randrange(40)) for i in range(9)] for q in range(6)}
    modules = spark.createDataFrame([(q, *m) for q, ms in docs.items() for m in ms], "doc_id int, node_id string, title string, input string")
    scopes = spark.createDataFrame([(q, q, m[0], i) for q, ms in docs.items() for i, m in enumerate(ms)], "query_id int, doc_id int, node_id string, place int")
    for most, whole in ((30, 10_000), (50, 200), (2200, 61), (0, 40)):
        found = {x["query_id"]: (x["modules"], x["source_text"]) for x in S.source_texts(scopes, modules, most, whole).collect()}
        assert found == {q: (9, plain_source(ms, most, whole)) for q, ms in docs.items()}


def test_nodes_without_a_module_have_no_text(spark):
    scopes = spark.createDataFrame([(1, 1, "a", 1)], "query_id int, doc_id int, node_id string, place int")
    none = spark.createDataFrame([], "doc_id int, node_id string, title string, input string")
    assert [tuple(x) for x in S.source_texts(scopes, none).collect()] == [(1, 1, "## 命中模块 1：a")]
    assert S.source_texts(scopes.limit(0), none).count() == 0


def test_module_text(spark):
    piece = "array<struct<pages:array<int>,content:string,title:string>>"
    grid = "array<struct<pages:array<int>,title:string,markdown:string>>"
    rows = [(1, "T", ["A", "T"], [([1, 2], "one", "x"), ([], "", "two"), ([3], None, "")], [([4], None, "| a |"), ([], "G", "| b |")]), (2, None, None, None, None)]
    found = [x[0] for x in spark.createDataFrame(rows, f"id int, title string, path array<string>, texts {piece}, tables {grid}").orderBy("id").select(S.skill_input(F.col("title"), F.col("path"), F.col("texts"), F.col("tables"))).collect()]
    assert found[0] == "模块：T\n路径：A / T\n\n## 文本\n- 第 1,2 页：one\n- 第 - 页：two\n\n## 表格\n\n### 表格 1（第 4 页）\n| a |\n\n### G（第 - 页）\n| b |\n"
    assert found[1] == "模块：\n路径：\n\n## 文本\n"


def test_previews_are_hydrated(spark):
    modules = spark.createDataFrame([(1, "a", "A", "x" * 300), (1, "b", "", "y"), (1, "c", "C", " ")], "doc_id int, node_id string, title string, input string")
    wanted = spark.createDataFrame([(q, 1, n, i) for q in (1, 2, 3) for i, n in enumerate(["a", "gone", "b", "c"], 1)] + [(4, 1, "c", 1)], "query_id int, doc_id int, node_id string, number int")
    whole = f"## 命中模块 1：A\n{'x' * 300}\n\n## 命中模块 3：b\ny"
    given = [(1, "short"), (2, "z" * (len(whole) - 200)), (3, "z" * 999 + S.SOURCE_CUT), (4, None), (5, "t")]
    found = {x["query_id"]: (x["hydrated"], x["source_text"]) for x in S.hydrated(spark.createDataFrame(given, "query_id int, source_text string"), wanted, modules).collect()}
    assert found == {1: ("used", whole), 2: ("complete", given[1][1]), 3: ("used", whole), 4: ("not_found", None), 5: ("not_found", "t")}
