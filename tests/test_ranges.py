"""Nodes of a tree and the ranges that their texts fit."""

from leafline.operators import ranges


def matched(spark, nodes, held):
    a = spark.createDataFrame([(1, *n) for n in nodes], "doc_id int, node_id string, pages array<int>, text string")
    b = spark.createDataFrame([(1, p, i, r, t) for i, (r, p, t) in enumerate(held)], "doc_id int, page_no int, ord int, range_id string, text string")
    return {r["node_id"]: (r["range_id"], r["score"]) for r in ranges.text_matches(a, b).collect()}


def test_parts_of_the_score(spark):
    found = matched(
        spark,
        [("same", [1], "Alpha-Beta <|txt_split|>gamma"), ("loose", [], "alpha beta gamma"), ("far", [9], "alpha"), ("none", [1], " -- "), ("few", [2], "abcd"), ("below", [2], "zzyx")],
        [("r1", 1, "ALPHA beta"), ("r2", 1, "alpha beta"), ("r3", 2, "abxy efgh"), ("r4", 1, "")],
    )
    assert found["same"] == ("r1", 1.22) and found["loose"] == ("r1", 1.14)  # of equal ones the first
    assert found["few"] == ("r3", round(0.08 + 0.32 * 2 / 4, 6))
    assert set(found) == {"same", "loose", "few", "below"} and found["below"] == ("r3", round(0.08 + 0.32 * 2 / 3, 6))


def test_only_the_opening_is_in_the_longer_text(spark):
    node = "a" * 180 + "bcd"
    found = matched(spark, [("n", [1], node)], [("r", 1, "x" + "a" * 180 + "y" * 10)])
    assert found == {"n": ("r", round(0.08 + 0.22 + 0.32 / 4, 6))}


def test_a_weak_match_is_none(spark):
    assert matched(spark, [("n", [1], "abcdefgh")], [("r", 1, "azzzzzzzzz")]) == {}
