"""Repair of document trees whose headings were given too few levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.lineage import cut
from leafline.operators.tree import nested
from leafline.operators.treebuild import SUPPLEMENT_KINDS, numbered_levels, visual_levels

#: Kinds that stay where they are.
ASIDE_KINDS = (*SUPPLEMENT_KINDS, "image", "chart", "table_caption")
PLACED = {"content": "string", "page": "long", "x0": "double", "y0": "double", "x1": "double", "y1": "double", "right": "double"}


def renested(siblings: DataFrame) -> DataFrame:
    """Nodes of one parent with ``level`` as their headings tell it and ``above``, the sibling that each now lies below, null where it stays.

    Levels come from numbers if any of the siblings has one, else from how they
    stand on the page; if neither tells more than was known, all stay. A node
    without a level goes below the last sibling with one.
    """
    group = F.struct("doc_id", F.col("parent_id").alias("p"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("moved", "ord"))
    held = siblings.withColumn("place", turn.cast("long")).withColumn("g", group)
    inner = held.select(F.col("g").alias("doc_id"), F.col("place").alias("ord"), "node_id", "title", "kind", "level", *PLACED)
    leveled = visual_levels(numbered_levels(inner))
    found = F.coalesce("numbered", "visual", "level")
    changed = F.max(F.coalesce(F.col("numbered").isNotNull() | (F.coalesce("visual", "level") != F.col("level")), F.lit(False))).over(Window.partitionBy("doc_id"))
    leveled = leveled.withColumn("found", found).withColumn("changed", changed)
    moves = leveled.where(F.col("changed") & ~F.col("kind").isin(*ASIDE_KINDS)).select("doc_id", "ord", "node_id", F.col("found").alias("level"))
    heads = nested(moves.where(F.col("level") > 0)).select("doc_id", "ord", F.col("parent_id").alias("above"))
    last = F.last(F.when(F.col("level") > 0, F.col("node_id")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    loose = moves.withColumn("above", last).where(F.coalesce("level", F.lit(0)) <= 0).select("doc_id", "ord", "above")
    above = heads.unionByName(loose).select(F.col("doc_id").alias("d"), F.col("ord").alias("o"), "above")
    levels = leveled.select(F.col("doc_id").alias("g2"), F.col("ord").alias("p2"), F.when(F.col("changed"), F.col("found")).otherwise(F.col("level")).alias("new_level"))
    out = held.join(levels, (F.col("g") == F.col("g2")) & (F.col("place") == F.col("p2"))).join(above, (F.col("g") == F.col("d")) & (F.col("place") == F.col("o")), "left")
    return out.drop("level", "g", "g2", "p2", "d", "o", "place").withColumnRenamed("new_level", "level")


def repaired(nodes: DataFrame) -> DataFrame:
    """Trees with headings nested as their numbers or their places say: ``doc_id, node_id, parent_id, level``.

    ``nodes`` has ``doc_id, node_id, parent_id`` (null below the root), ``ord,
    kind, title, level`` and, where known, ``content, page, x0, y0, x1, y1`` and
    ``right``. From the root down, the children of all nodes of a depth are
    nested anew at once; what moved below a sibling comes behind the children
    that this had, and is looked at with them. So there are as many rounds as
    the repaired tree is deep. A node whose parent is missing stays as it is.
    """
    known = {c.lower() for c in nodes.columns}
    columns = ["doc_id", "node_id", "parent_id", "ord", "kind", "title", F.col("level").cast("int").alias("level"), *[F.col(c) if c in known else F.lit(None).cast(t).alias(c) for c, t in PLACED.items()]]
    waiting = nodes.select(*columns, F.lit(0).alias("moved"))
    parts, front, turn = [], None, 0
    while True:
        if front is None:
            here, rest = waiting.where(F.col("parent_id").isNull()), waiting.where(F.col("parent_id").isNotNull())
        else:
            on = (F.col("doc_id") == F.col("fd")) & (F.col("parent_id") == F.col("fn"))
            here, rest = waiting.join(front, on, "left_semi"), waiting.join(front, on, "left_anti")
        turn += 1
        done = cut(renested(here))
        stay = done.where(F.col("above").isNull())
        if not stay.take(1):
            break
        parts.append(stay.select("doc_id", "node_id", "parent_id", "level"))
        moved = done.where(F.col("above").isNotNull()).withColumn("parent_id", F.col("above")).withColumn("moved", F.lit(turn))
        waiting = cut(rest.unionByName(moved.select(*rest.columns)))
        front = stay.select(F.col("doc_id").alias("fd"), F.col("node_id").alias("fn"))
    parts.append(waiting.select("doc_id", "node_id", "parent_id", "level"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
