"""Document trees from elements: components, heading levels, special and supplement nodes.

Elements are ordered rows of a document; what a heading governs, and which level
it has, comes from windows over that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import spaces
from leafline.operators.tree import nested, number_vector

#: Kinds of elements that hang on a heading, and that stand beside the text.
SPECIAL_KINDS = ("table", "chart", "image", "seal", "image_block")
SUPPLEMENT_KINDS = ("page_title", "page_number", "page_footnote", "header", "aside_text", "footer")
UNTITLED, WHOLE = "未命名标题", "文档内容"
#: What a centred heading is on a page, in thousandths, and how close a subtitle follows.
OFF_CENTRE, LEFT_FROM, WIDEST, CLOSE = 160, 180, 720, 32


def _filled(text: Column) -> Column:
    return F.coalesce(spaces(text), F.lit("")) != ""


def components(elements: DataFrame) -> DataFrame:
    """Headings with the body texts below them, and the texts before the first heading as a component of their own.

    ``elements`` has ``doc_id, ord, kind, level, page, content, block_id`` and
    ``x0, y0, x1, y1``. Returns ``doc_id, ord`` (of the heading, 0 without),
    ``title, level, content`` (a line a text), ``block_ids``, the heading's
    ``page`` and box, and ``right``, the furthest right of all its boxes. A
    heading of a negative level is body text.
    """
    title = (F.col("kind") == "title") & (F.coalesce("level", F.lit(1)) >= 0)
    text = elements.where(~F.col("kind").isin(*SPECIAL_KINDS, *SUPPLEMENT_KINDS)).withColumn("head", title).where(F.col("head") | _filled(F.col("content")))
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    owned = text.withColumn("owner", F.coalesce(F.last(F.when(F.col("head"), F.col("ord")), ignorenulls=True).over(so_far), F.lit(0)))
    heading = F.max(F.when(F.col("head"), F.struct("content", "level", "page", "x0", "y0", "x1", "y1"))).alias("h")
    body = F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.when(~F.col("head"), spaces(F.col("content"))).alias("t")))), lambda x: x["t"]))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id"))), lambda x: x["block_id"])
    held = owned.groupBy("doc_id", F.col("owner").alias("ord")).agg(heading, F.array_join(body, "\n").alias("content"), blocks.alias("block_ids"), F.max("x1").alias("right"))
    name = F.when(F.col("h").isNull(), WHOLE).otherwise(F.coalesce(F.when(_filled(F.col("h.content")), F.col("h.content")), F.lit(UNTITLED)))
    level = F.when(F.coalesce("h.level", F.lit(0)) == 0, 1).otherwise(F.col("h.level"))
    return held.select("doc_id", "ord", name.alias("title"), level.cast("int").alias("level"), "content", "block_ids", "h.page", "h.x0", "h.y0", "h.x1", "h.y1", "right")


def local_marker(title: Column) -> Column:
    """Whether a heading begins with a short mark in brackets, such as (1) or （一）."""
    mark = F.trim(F.regexp_extract(spaces(title), r"^[(（\[【]([^)）\]】]+)[)）\]】]", 1))
    return (mark != "") & (F.length(mark) <= 12)


def numbered_levels(held: DataFrame) -> DataFrame:
    """Components with ``numbered``, their level where their document has numbered headings, null where it has none.

    Numbers as long as the shortest keep the least level that those have, longer
    ones lie deeper; a mark in brackets lies below the last number before it,
    and other headings keep their level.
    """
    n = F.size(number_vector(F.col("title")))
    marked = held.withColumn("n", n)
    whole = Window.partitionBy("doc_id")
    shortest = F.min(F.when((F.col("n") > 0) & (F.col("level") > 0), F.col("n"))).over(whole)
    marked = marked.withColumn("shortest", shortest)
    base = F.min(F.when((F.col("n") == F.col("shortest")) & (F.col("level") > 0), F.col("level"))).over(whole)
    marked = marked.withColumn("base", base)
    deep = F.when(F.col("n") > 0, F.greatest(F.lit(1), F.col("base") + F.greatest(F.col("n") - F.col("shortest"), F.lit(0))))
    marked = marked.withColumn("deep", deep)
    last = F.last("deep", ignorenulls=True).over(whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    found = F.coalesce("deep", F.when(local_marker(F.col("title")) & last.isNotNull(), last + 1), F.col("level"))
    return marked.withColumn("numbered", F.when(F.col("base").isNotNull(), found).cast("int")).drop("n", "shortest", "base", "deep")


def visual_levels(held: DataFrame) -> DataFrame:
    """Components with ``visual``, their level by how headings stand on the page, null where that tells nothing.

    Of documents with three headings or more, all of one level, some centred and
    some not: centred ones have that level, others lie below, and one that
    follows another closely, without body between, and is much longer or ends
    with a colon, lies below that. Boxes are in page units.
    """
    whole = Window.partitionBy("doc_id")
    sized = held.withColumn("width", F.max("right").over(whole))
    wide, middle = F.col("x1") - F.col("x0"), (F.col("x0") + F.col("x1")) / 2
    centred = (F.abs(middle - F.col("width") / 2) * 1000 <= F.col("width") * OFF_CENTRE) & (F.col("x0") * 1000 >= F.col("width") * LEFT_FROM) & (wide * 1000 <= F.col("width") * WIDEST)
    sized = sized.withColumn("centred", F.when(F.col("x0").isNotNull() & (F.col("width") > 0), centred))
    # only headings that have a box say where they stand, and count as the one before
    boxed = F.col("centred").isNotNull()
    placed = sized.withColumn("heads", F.count("*").over(whole)).withColumn("kinds", F.size(F.collect_set(F.when(F.col("level") > 0, F.col("level"))).over(whole)))
    placed = placed.withColumn("mixed", (F.max(F.col("centred").cast("int")).over(whole) == 1) & (F.min(F.col("centred").cast("int")).over(whole) == 0))
    placed = placed.withColumn("base", F.coalesce(F.min(F.when(F.col("level") > 0, F.col("level"))).over(whole), F.lit(1)))
    before = whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(boxed, F.struct("title", "content", "page", "y1")), ignorenulls=True).over(before)
    placed = placed.withColumn("last", last)
    gap = F.col("y0") - F.col("last.y1")
    longer = F.length("title") >= F.greatest(F.length("last.title") + 6, F.length("last.title") * 2)
    follows = boxed & F.col("last").isNotNull() & ~_filled(F.col("last.content")) & F.coalesce(F.col("page") == F.col("last.page"), F.lit(True)) & gap.between(-1, CLOSE) & (longer | F.col("title").rlike("(：|:|如下)$"))
    placed = placed.withColumn("fresh", F.when(boxed & (F.col("centred") | ~F.coalesce(follows, F.lit(False))), 1).otherwise(0))
    run = F.sum("fresh").over(whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("run", run)
    inside = Window.partitionBy("doc_id", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(boxed, F.when(F.col("centred"), F.col("base")).otherwise(F.col("base") + 1)), ignorenulls=True).over(inside)
    level = F.when(boxed, first + F.sum(boxed.cast("int")).over(inside) - 1).otherwise(F.col("level"))
    tells = (F.col("heads") >= 3) & (F.col("kinds") <= 1) & F.col("mixed") & (F.col("width") > 0)
    return placed.withColumn("visual", F.when(tells, level).cast("int")).select(*held.columns, "visual")


def levelled(held: DataFrame) -> DataFrame:
    """Components with the level of their number, else of how they stand, else their own."""
    both = visual_levels(numbered_levels(held))
    return both.withColumn("level", F.coalesce("numbered", "visual", "level")).drop("numbered", "visual")


def special_nodes(elements: DataFrame, held: DataFrame) -> DataFrame:
    """Tables, images and the like below the component whose block they name, else that of the last heading before, else the root.

    ``elements`` has ``image_of``, the block they belong to, or null.
    """
    owners = held.select("doc_id", F.col("ord").alias("component"), F.explode("block_ids").alias("block")).groupBy("doc_id", "block").agg(F.min("component").alias("component"))
    so_far = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    near = elements.withColumn("last_title", F.last(F.when(F.col("kind") == "title", F.col("block_id")), ignorenulls=True).over(so_far)).where(F.col("kind").isin(*SPECIAL_KINDS))
    named = owners.select("doc_id", F.col("block").alias("image_of"), F.col("component").alias("a"))
    titled = owners.select("doc_id", F.col("block").alias("last_title"), F.col("component").alias("b"))
    met = near.join(named, ["doc_id", "image_of"], "left").join(titled, ["doc_id", "last_title"], "left")
    return met.select("doc_id", "ord", "kind", F.coalesce(spaces(F.col("title")), F.lit("")).alias("title"), F.coalesce("a", "b").alias("parent_ord"))


def supplement_nodes(elements: DataFrame) -> DataFrame:
    """Headers, footers and the like below the root, named by page and kind, the second of a name as 1 and so on."""
    some = elements.where(F.col("kind").isin(*SUPPLEMENT_KINDS))
    place = F.row_number().over(Window.partitionBy("doc_id", "page", "kind").orderBy("ord")) - 1
    name = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" - "), "kind")
    return some.withColumn("n", place).select("doc_id", "ord", "kind", F.when(F.col("n") == 0, name).otherwise(F.concat(name, F.lit(" - "), F.col("n").cast("string"))).alias("title"))


def built(elements: DataFrame) -> DataFrame:
    """All nodes of each document's tree: ``doc_id, ord, kind, title, level, parent_ord``, -1 being the root; ``level`` is -1 for what is no heading."""
    held = levelled(components(elements))
    heads = nested(held.select("doc_id", "ord", F.col("ord").alias("node_id"), "title", F.when(F.col("level") > 0, F.col("level")).otherwise(100).alias("level")))
    text = heads.select("doc_id", "ord", F.lit("text").alias("kind"), "title", "level", F.coalesce("parent_id", F.lit(-1)).alias("parent_ord"))
    none = F.lit(-1)
    special = special_nodes(elements, held).select("doc_id", "ord", "kind", "title", none.alias("level"), F.coalesce("parent_ord", none).alias("parent_ord"))
    beside = supplement_nodes(elements).select("doc_id", "ord", "kind", "title", none.alias("level"), none.alias("parent_ord"))
    return text.unionByName(special).unionByName(beside)


def table_lookup(elements: DataFrame) -> DataFrame:
    """The table of each page and title: of several the last in order; tables without title or markup have none."""
    named = elements.where("kind = 'table'").withColumn("name", F.coalesce(F.when(_filled(F.col("title")), spaces(F.col("title"))), spaces(F.col("content"))))
    some = named.where(_filled(F.col("name")) & (F.coalesce("html", F.lit("")) != ""))
    return some.groupBy("doc_id", "page", F.col("name").alias("title")).agg(F.max_by("html", "ord").alias("html"), F.max("ord").alias("ord"))


def range_matches(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The range on the page that each node covers best, by shared area in thousandths of the smaller one; of equal ones the first.

    Both have ``doc_id, page`` and ``x0, y0, x1, y1`` as shares of the page in
    thousandths; a page bounds how many meet.
    """
    r = ranges.select("doc_id", "page", "range_id", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    met = nodes.join(r, ["doc_id", "page"])

    def side(low: str, high: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(high), F.col(f"r{high}")) - F.greatest(F.col(low), F.col(f"r{low}")))

    area = F.least((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("rx1") - F.col("rx0")) * (F.col("ry1") - F.col("ry0")))
    score = F.when(area > 0, F.floor(side("x0", "x1") * side("y0", "y1") * 1000 / area)).otherwise(0)
    best = F.max(F.struct(score.cast("long").alias("score"), (-F.col("range_id")).alias("r"))).alias("b")
    return met.groupBy("doc_id", "node_id").agg(best).where("b.score > 0").select("doc_id", "node_id", (-F.col("b.r")).alias("range_id"), F.col("b.score").alias("score"))
