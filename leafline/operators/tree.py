"""Document trees as adjacency rows: levels, nesting, modules and scopes.

Documents are ordered rows; what a heading governs is found with windows over
the document's order, never by recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_vector(title: Column) -> Column:
    """The leading numbers of a heading such as ``1.2.3 name``; empty if none."""
    head = F.regexp_extract(title, r"^\s*([0-9]+(?:\.[0-9]+)*)(?:[.\s、]|$)", 1)
    return F.when(head == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(head, r"\."), lambda x: x.cast("int")))


def heading_levels(headings: DataFrame) -> DataFrame:
    """The level of each numbered heading, from one for the document's shortest numbers; 0 without numbers."""
    held = headings.withColumn("_n", F.size(number_vector(F.col("title"))))
    least = F.min(F.when(F.col("_n") > 0, F.col("_n"))).over(Window.partitionBy("doc_id"))
    return held.withColumn("level", F.when(F.col("_n") > 0, F.col("_n") - least + 1).otherwise(0)).drop("_n")


def _nearest(headings: DataFrame, before: bool) -> DataFrame:
    """Per heading (``doc_id, ord``) the nearest one before it of a smaller level, or behind it of its own or a smaller one, as ``near``: its ``ord`` and ``node_id``.

    Each heading asks once for each smaller level that its document has (and,
    behind it, for its own), and the headings of that level answer it in order: so
    levels may be of any depth, and the levels of a document are ordered apart.
    """
    levels = headings.select(F.col("doc_id").alias("d"), F.col("level").alias("k")).distinct()
    smaller = (F.col("k") < F.col("level")) if before else (F.col("k") <= F.col("level"))
    asks = headings.join(levels, (F.col("doc_id") == F.col("d")) & smaller).select("doc_id", "k", "ord", F.lit(None).cast(dict(headings.dtypes)["node_id"]).alias("node_id"), F.lit(1).alias("asks"))
    own = headings.select("doc_id", F.col("level").alias("k"), "ord", "node_id", F.lit(0).alias("asks"))
    # a heading that asks its own level stands behind itself read forwards, and before itself read backwards
    order = ["ord"] if before else [F.desc("ord"), F.desc("asks")]
    so_far = Window.partitionBy("doc_id", "k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("asks") == 0, F.struct("ord", "node_id")), ignorenulls=True).over(so_far)
    answered = own.unionByName(asks).withColumn("near", last).where((F.col("asks") == 1) & F.col("near").isNotNull())
    best = F.max("near") if before else F.min("near")
    return answered.groupBy("doc_id", "ord").agg(best.alias("near"))


def nested(headings: DataFrame) -> DataFrame:
    """Each heading's parent: the nearest one before it with a smaller level."""
    found = _nearest(headings, True).select(F.col("doc_id").alias("_d"), F.col("ord").alias("_o"), F.col("near.node_id").alias("parent_id"))
    given = headings.drop("parent_id")
    return given.join(found, (F.col("doc_id") == F.col("_d")) & (F.col("ord") == F.col("_o")), "left").drop("_d", "_o")


def subtree_end(headings: DataFrame) -> DataFrame:
    """Where each heading's subtree ends: the order of the next heading of its level or a smaller one, null at the end."""
    found = _nearest(headings, False).select(F.col("doc_id").alias("_d"), F.col("ord").alias("_o"), F.col("near.ord").alias("end_ord"))
    given = headings.drop("end_ord")
    return given.join(found, (F.col("doc_id") == F.col("_d")) & (F.col("ord") == F.col("_o")), "left").drop("_d", "_o")


def grouped_body(elements: DataFrame) -> DataFrame:
    """Body elements under the last heading before them; those before the first have none.

    ``elements`` has ``doc_id, ord, kind`` (title or other) and ``text``.
    """
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("kind") == "title", F.col("ord")), ignorenulls=True).over(so_far)
    held = elements.withColumn("title_ord", title)
    body = F.when(F.col("kind") != "title", F.col("text"))
    out = held.groupBy("doc_id", "title_ord").agg(F.count(body).alias("parts"), F.sum(F.coalesce(F.length(body), F.lit(0))).alias("chars"), F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title"))
    return out


def modules(headings: DataFrame) -> DataFrame:
    """Numbered modules of each document in order: ``doc_id, module_id, node_id, title, level, members``.

    ``members`` counts the headings of the subtree, itself included.
    """
    ended = subtree_end(headings)
    later = Window.partitionBy("doc_id").orderBy("ord")
    held = ended.withColumn("place", F.row_number().over(later)).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    ends = held.select(F.col("doc_id").alias("d"), F.col("ord").alias("o"), F.col("place").alias("end_place"))
    out = held.join(ends, (F.col("doc_id") == F.col("d")) & (F.col("end_ord") == F.col("o")), "left")
    members = F.coalesce("end_place", F.col("total") + 1) - F.col("place")
    return out.select("doc_id", F.format_string("module_%03d", "place").alias("module_id"), "node_id", "title", "level", members.cast("long").alias("members"))


def dispatch(modules_: DataFrame, pages: DataFrame) -> DataFrame:
    """A step for each module but those of a whole document: top-level ones over more than one page."""
    held = modules_.join(pages, ["doc_id", "node_id"])
    return held.where(~((F.col("level") == 1) & (F.col("page_count") > 1))).select("doc_id", "module_id", F.concat(F.lit("step_"), "module_id").alias("step_id"), F.when(F.col("members") > 1, 60).otherwise(90).alias("confidence"))


def scope(headings: DataFrame, chosen: DataFrame) -> DataFrame:
    """What belongs to chosen headings: each with the headings after it up to the first of its level or above."""
    ended = subtree_end(headings)
    picked = ended.join(chosen, ["doc_id", "node_id"]).select("doc_id", F.col("node_id").alias("anchor_id"), F.col("ord").alias("s"), F.col("end_ord").alias("e"))
    held = headings.join(picked, "doc_id").where((F.col("ord") >= F.col("s")) & (F.col("e").isNull() | (F.col("ord") < F.col("e"))))
    return held.select("doc_id", "anchor_id", "node_id", F.when(F.col("node_id") == F.col("anchor_id"), "anchor").otherwise("descendant").alias("reason"))


def reading_ranges(blocks: DataFrame, gap: int = 26, overlap: int = 20) -> DataFrame:
    """Neighbouring blocks of one kind merged where they nearly touch.

    ``blocks`` has ``page_no, block_id, kind`` and ``x0, y0, x1, y1`` in
    thousandths. Blocks go by top, then left; a block joins the one before if
    the gap is at most ``gap`` thousandths and they share ``overlap`` percent of
    the narrower one's width.
    """
    order = Window.partitionBy("page_no").orderBy("y0", "x0", "block_id")
    before = {c: F.lag(c).over(order) for c in ("kind", "x0", "x1", "y1")}
    shared = F.least("x1", before["x1"]) - F.greatest("x0", before["x0"])
    narrow = F.least(F.col("x1") - F.col("x0"), before["x1"] - before["x0"])
    joins = (before["kind"] == F.col("kind")) & (F.col("y0") - before["y1"] <= gap) & (shared * 100 >= narrow * overlap)
    held = blocks.withColumn("fresh", F.when(joins, 0).otherwise(1)).withColumn("range_no", F.sum("fresh").over(order))
    return held.groupBy("page_no", "range_no").agg(F.first("kind").alias("kind"), F.count("*").alias("blocks"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
