"""Trees of any depth, and their repair."""

import random

from leafline.operators import repair, tree


def plain_parents(levels):
    return [next((j for j in range(i - 1, -1, -1) if levels[j] < x), None) for i, x in enumerate(levels)]


def plain_ends(levels):
    return [next((j for j in range(i + 1, len(levels)) if levels[j] <= x), None) for i, x in enumerate(levels)]


def test_levels_of_any_depth(spark):
    r = random.Random(2)
    docs = {1: list(range(1, 13)) + [8, 9, 12, 3, 40, 41, 40, 2], 2: [r.randrange(1, 15) for _ in range(60)], 3: [100, 100, 7], 4: [5]}
    rows = [(d, i, f"{d}-{i}", x) for d, levels in docs.items() for i, x in enumerate(levels)]
    headings = spark.createDataFrame(rows, "doc_id int, ord int, node_id string, level int")
    parents = {(x["doc_id"], x["ord"]): x["parent_id"] for x in tree.nested(headings).collect()}
    ends = {(x["doc_id"], x["ord"]): x["end_ord"] for x in tree.subtree_end(headings).collect()}
    for d, levels in docs.items():
        assert [parents[d, i] for i in range(len(levels))] == [None if p is None else f"{d}-{p}" for p in plain_parents(levels)]
        assert [ends[d, i] for i in range(len(levels))] == plain_ends(levels)


def tree_of(spark, rows):
    """Repaired rows (node, parent, title, level[, kind]) of one document, as {node: (parent, level)}."""
    given = [(1, n, p, i, kind[0] if kind else "title", t, lv) for i, (n, p, t, lv, *kind) in enumerate(rows)]
    nodes = spark.createDataFrame(given, "doc_id int, node_id string, parent_id string, ord long, kind string, title string, level int")
    return {x["node_id"]: (x["parent_id"], x["level"]) for x in repair.repaired(nodes).collect()}


def test_flat_numbers_are_nested(spark):
    found = tree_of(spark, [("a", None, "1 A", 1), ("b", None, "1.1 B", 1), ("c", None, "1.1.1 C", 1), ("m", None, "(1) mark", 1), ("d", None, "1.2 D", 1), ("e", None, "2 E", 1), ("f", None, "no number", 1), ("x", None, "page foot", 0, "footer")])
    assert found == {"a": (None, 1), "b": ("a", 2), "c": ("b", 3), "m": ("c", 4), "d": ("a", 2), "e": (None, 1), "f": (None, 1), "x": (None, 0)}


def test_repair_goes_down_and_takes_what_moved_behind_the_children_there(spark):
    # c lies below a already; b moves there behind it, so c stays and b stays
    found = tree_of(spark, [("a", None, "1 A", 1), ("b", None, "1.1 B", 1), ("c", "a", "1.1.1 C", 1), ("d", "b", "1.1.2 D", 1), ("e", "b", "1.1.2.1 E", 1)])
    assert found == {"a": (None, 1), "b": ("a", 2), "c": ("a", 3), "d": ("b", 1), "e": ("d", 2)}


def test_without_numbers_or_places_all_stays(spark):
    rows = [("a", None, "A", 1), ("b", None, "B", 1), ("c", "b", "C", 3), ("o", "missing", "O", 2)]
    assert tree_of(spark, rows) == {n: (p, lv) for n, p, _, lv in rows}


def test_nodes_without_a_level_go_below_the_last_with_one(spark):
    found = tree_of(spark, [("a", None, "1 A", 1), ("n", None, "loose", 0), ("b", None, "1.1 B", 1), ("o", None, "loose too", None)])
    assert found == {"a": (None, 1), "n": ("a", 0), "b": ("a", 2), "o": ("b", None)}
