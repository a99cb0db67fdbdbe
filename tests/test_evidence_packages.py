"""Evidence items, the inverted index, selections and reports."""

import random

import pytest

from leafline.operators import evidence_packages as P


@pytest.mark.parametrize("seed,most", [(1, 1), (2, 2), (3, 5)])
def test_best_items_against_brute_force(spark, seed, most):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    pick = lambda n: [r.choice(words[: r.choice([3, 10, 30])]) for _ in range(n)]
    items = [(i, r.randrange(4), pick(r.randrange(12))) for i in range(60)]
    queries = [(q, pick(r.randrange(9)) + ["never"] * (q % 2)) for q in range(25)]
    found = P.best_items(spark.createDataFrame(items, "id int, page_no int, words array<string>"), spark.createDataFrame(queries, "query_id int, words array<string>"), most).collect()
    wanted = []
    for q, asked in queries:
        hits = sorted((-len(set(asked) & set(own)), page, i) for i, page, own in items if set(asked) & set(own))
        wanted += [(q, k + 1, i, -n) for k, (n, _, i) in enumerate(hits[:most])]
    assert sorted(map(tuple, found)) == wanted


def test_common_words_are_not_read_once_the_best_are_known(spark, monkeypatch):
    items = spark.createDataFrame([(i, 1, ["the", "of"] + (["rare", "odd", "x"] if i < 3 else [])) for i in range(50)], "id int, page_no int, words array<string>")
    sizes = []
    cut = P.cut
    monkeypatch.setattr(P, "cut", lambda df: sizes.append(cut(df)) or sizes[-1])
    found = P.best_items(items, spark.createDataFrame([(1, ["rare", "the", "odd", "of", "x"])], "query_id int, words array<string>"), 2)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(1, 1, 0, 5), (1, 2, 1, 5)]
    assert max(df.count() for df in sizes if "c" in df.columns) == 3


BLOCK = "doc_id int, page_no int, block_index int, kind string, title string, text string, rows array<string>, shape_type string, warnings array<string>"
REF = "doc_id int, page_no int, block_index int, ref_id string, block_id string, source_ordinal string, nearby_title string, excerpt string, uncertainties array<string>"


def test_items_of_blocks(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "", " T ", "x" * 700, None, None, None), (1, 1, 1, "title", None, None, ["a", " ", "b", "c", "d", "e"], "record_table", ["w", "w"])], BLOCK)
    refs = spark.createDataFrame([(1, 1, 1, None, "blk", "o7", "near", "ex", ["u", "w"])], REF)
    a, b = P.index_items(blocks, refs).orderBy("block_index").collect()
    assert (a["id"], a["source_type"], a["title"], a["excerpt"]) == ("ev2:p1:b0", "text", "T", "x" * 640 + "...")
    assert (b["id"], b["source_type"], b["excerpt"], b["shape_type"], b["uncertainties"], b["key"]) == ("o7", "table", "ex a b c d", "record_table", ["u", "w"], "nearexabcdabcde")


CONTRACT = "query_id int, doc_id int, output_type string, fields array<string>, terms array<string>, pages array<int>, selected array<string>, source_text string"


def chosen(spark, contracts, blocks):
    rows = [(1, page, i, "", "", text, rows, shape, [f"u{k}" for k in range(unsure)]) for page, i, text, rows, shape, unsure in blocks]
    items = P.index_items(spark.createDataFrame(rows, BLOCK), spark.createDataFrame([], REF))
    asked = spark.createDataFrame(contracts, CONTRACT)
    found = P.selections(asked, items)
    return asked, items, found, [(r["query_id"], r["id"], r["score"], r["reason"], r["target"]) for r in found.orderBy("query_id", "rank").collect()]


def test_fields_then_context(spark):
    blocks = [(1, 0, "Price: 5", None, None, 0), (1, 1, "short text", None, None, 0), (1, 2, "y " * 300, None, None, 0), (1, 20, "far off", None, None, 0), (2, 0, "other page: x", None, None, 0)]
    *_, rows = chosen(spark, [(1, 1, "field_list", ["Price", "Name", "Date"], [], [], [], None)], blocks)
    # the label counts twice, as a whole and as a word; half of three fields, two at least, are wanted
    assert rows == [(1, "ev2:p1:b1", 46, "context", "__context__"), (1, "ev2:p1:b0", 40, "field", "Price"), (1, "ev2:p1:b2", 29, "context", "__context__")]


def test_fallback_where_no_field_is_found(spark):
    blocks = [(1, 0, "abc", None, None, 0), (2, 0, "def", None, None, 0), (2, 1, "unsure", None, None, 3)]
    *_, rows = chosen(spark, [(1, 1, "field_list", ["Nowhere"], ["abc"], [1], [], None)], blocks)
    assert rows[0] == (1, "ev2:p1:b0", 15 + 32, "fallback", "")


def test_records(spark):
    blocks = [(1, 0, "", ["r"], "record_table", 0), (1, 1, "", ["abc"], "table", 0), (1, 2, "abc", None, None, 0), (1, 3, "", ["z"], "table", 9)]
    contracts = [(1, 1, "record_collection", [], ["abc"], [], [], None), (2, 1, "record_collection", [], ["abc"], [], ["b2"], None), (3, 1, "record_collection", [], [], [4, 3], [], "source"), (4, 1, "record_collection", [], [], [], ["none"], None), (5, 1, "", [], ["abc"], [], [], None)]
    *_, rows = chosen(spark, contracts, blocks)
    assert rows[:2] == [(1, "ev2:p1:b0", 43, "table", ""), (1, "ev2:p1:b1", 32, "table", "")]
    assert [r for r in rows if r[0] == 2] == [(2, "ev2:p1:b2", 77, "scope", "")]
    assert [r for r in rows if r[0] == 3] == [(3, "runtime-contract-selected-source", 100, "source", "")]
    assert [r for r in rows if r[0] == 4] == [(4, "ev2:p1:b0", 35, "table", "")]
    assert {r[1]: r[2] for r in rows if r[0] == 5} == {"ev2:p1:b1": 32, "ev2:p1:b2": 32, "ev2:p1:b0": 8}


def test_report_is_cut_at_its_last_piece(spark):
    asked, items, found, _ = chosen(spark, [(1, 1, "x", ["A", " "], ["abc"], [], [], None), (2, 1, "x", [], ["nowhere"], [], ["none"], None)], [(1, 0, "abc", None, None, 1)])
    whole = "# Evidence V2 Shadow Render\noutputType: x\nfields: A\n\n## ev2:p1:b0 page=1 source=text\nreasons: generic\nexcerpt: abc\nuncertainties: u0"
    text = {r["query_id"]: r["report"] for r in P.report(asked, found, items).collect()}
    assert text == {1: whole, 2: "# Evidence V2 Shadow Render\noutputType: x"}
    for most in (60, len(whole) - 1, len(whole)):
        text = {r["query_id"]: r["report"] for r in P.report(asked, found, items, most).collect()}
        assert text[1] == (whole if most == len(whole) else whole[:most] + "\n[truncated]")


def test_no_field_named(spark):
    """the two best of the terms, or the best of the scope."""
    blocks = [(1, i, "abc", None, None, i) for i in range(4)]
    contract = (1, 1, "field_list", [" "], ["abc"], [], [], None)
    asked, items, _, rows = chosen(spark, [contract], blocks)
    assert [r[3] for r in rows] == ["field", "field"]
    found = P.selections(asked, items, unnamed=False).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["reason"]) for r in found] == [(f"ev2:p1:b{i}", 32 - 3 * i, "fallback") for i in range(4)]


@pytest.mark.parametrize("name", ["evidence_packages", "evidence_report"])
def test_an_item_of_short_words_against_sql(spark, tmp_path, name):
    """An item of the benchmark without a word of three letters names no field."""
    import duckdb

    from leafline.registry import core_oracles, core_queries

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'some text ' || i AS text, 'en' AS lang, 'src' || i % 4 AS source, 11 AS n_chars FROM range(0, 60) r(i)")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (0, 'a b c'), (1, 'some 12 words')) v(item_id, text)")
    for t in ("documents", "benchmark"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    found = core_queries()[name](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({core_oracles()[name]})").fetchall())


def test_postings_are_read_where_they_lie(spark, monkeypatch):
    """only postings of words that are asked for are kept, and queries' words go to them; both ways give the same."""
    items = spark.createDataFrame([(i, i % 3, [f"w{i % 7}", f"w{i % 5}", "the", f"odd{i}", None]) for i in range(60)] + [(60, 1, None)], "id int, page_no int, words array<string>")
    queries = spark.createDataFrame([(q, [f"w{q % 7}", "w1", "the", "never"]) for q in range(9)] + [(9, None)], "query_id int, words array<string>")
    kept = []
    persist = type(items).persist
    monkeypatch.setattr(type(items), "persist", lambda df, *level: kept.append(persist(df, *level)) or kept[-1])
    found = [sorted(map(tuple, P.best_items(items, queries, 3, n).collect())) for n in (1 << 20, 0)]
    assert found[0] == found[1] and len(found[0]) == 27
    assert len(kept) == 2
    assert {r["w"] for r in kept[0].select("w").collect()} == {"the", *(f"w{i}" for i in range(7))}
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" not in plan and "BroadcastHashJoin" in plan
    assert not any(df.is_cached for df in kept)
