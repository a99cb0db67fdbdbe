"""What was located in a document's tree as text to extract from: scopes of chosen nodes, their text within budgets, and what the scopes take in.

Places in a document stand for its nodes: a scope is an interval of places, so
nested and overlapping choices are united before any node is touched, and a
node is asked for by its place, never by a range over all nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.operators.tree import subtree_end

#: Most signs of a module's text, and of a whole source.
MODULE_SIGNS, SOURCE_SIGNS = 2200, 16000

#: Most rows of a document's tables at first, and in a review.
ROWS, REVIEW_ROWS = 32, 96

#: What follows a text that was cut, and what tells such a text.
MODULE_CUT = "\n...（模块预览已截断，完整证据范围见 contentRefs）"
SOURCE_CUT = "\n...（样例来源预览已截断，完整证据范围见 contentRefs）"
CUT_MARKS = ("模块预览已截断", "样例来源预览已截断")
HEADING = "## 命中模块 {}：{}"

#: By how much a whole text must be longer to take a given one's place.
LONGER = 200


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def skill_input(title: Column, path: Column, texts: Column, tables: Column) -> Column:
    """A module as text: title, path, a line for each text with its pages, then its tables.

    ``texts`` are structs of ``pages, content, title``, ``tables`` of ``pages,
    title, markdown``; null lists are empty, texts without content and title go.
    """
    none = lambda c: F.coalesce(c, F.lit(""))
    pages = lambda x: F.coalesce(F.nullif(F.array_join(x["pages"].cast("array<string>"), ","), F.lit("")), F.lit("-"))
    said = lambda x: F.coalesce(F.nullif(x["content"], F.lit("")), F.nullif(x["title"], F.lit("")))
    lines = F.transform(F.filter(texts, lambda x: said(x).isNotNull()), lambda x: F.concat(F.lit("- 第 "), pages(x), F.lit(" 页："), said(x)))
    name = lambda x, i: F.coalesce(F.nullif(x["title"], F.lit("")), F.concat(F.lit("表格 "), (i + 1).cast("string")))
    grids = F.transform(tables, lambda x, i: F.concat(F.lit("\n### "), name(x, i), F.lit("（第 "), pages(x), F.lit(" 页）\n"), none(x["markdown"])))
    empty = F.array().cast("array<string>")
    head = F.array(F.concat(F.lit("模块："), none(title)), F.concat(F.lit("路径："), none(F.array_join(path, " / "))), F.lit(""), F.lit("## 文本"))
    under = F.when(F.size(grids) > 0, F.concat(F.array(F.lit(""), F.lit("## 表格")), grids)).otherwise(empty)
    return F.concat(_stripped(F.array_join(F.concat(head, F.coalesce(lines, empty), under), "\n")), F.lit("\n"))


def united(spans: DataFrame, keys: list[str], touching: int = 0) -> DataFrame:
    """Intervals ``first`` to ``last`` (both in it) of each group united where they overlap, or lie at most ``touching`` apart.

    Empty intervals, with a null end or the last before the first, go. Equal
    starts are one row before anything is put in order.
    """
    longest = spans.where(F.col("first") <= F.col("last")).groupBy(*keys, "first").agg(F.max("last").alias("last"))
    ordered = Window.partitionBy(*keys).orderBy("first")
    reach = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = longest.withColumn("_new", F.when(F.col("first") <= reach + touching, 0).otherwise(1))
    numbered = fresh.withColumn("_no", F.sum("_new").over(ordered))
    return numbered.groupBy(*keys, "_no").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_no")


def placed(headings: DataFrame) -> DataFrame:
    """Headings with their ``place`` in the document, from 1, and the ``last`` place of their subtree."""
    ended = subtree_end(headings)
    held = ended.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))
    # whole documents by a grouped maximum, next siblings by an equality
    sizes = held.groupBy("doc_id").agg(F.max("place").alias("_all"))
    ends = held.select("doc_id", F.col("ord").alias("end_ord"), F.col("place").alias("_end"), F.col("node_id").alias("end_node"))
    out = held.join(sizes, "doc_id").join(ends, ["doc_id", "end_ord"], "left")
    return out.withColumn("last", F.coalesce(F.col("_end") - 1, F.col("_all"))).drop("_end", "_all", "end_ord")


def scope_rows(places: DataFrame, chosen: DataFrame) -> DataFrame:
    """The nodes in the scope of each query's choice, each once: ``query_id, doc_id, node_id, place, reason``.

    ``places`` is what ``placed`` gives, ``chosen`` has ``query_id, doc_id,
    node_id``. The reason is ``selected_node`` for a chosen one, else
    ``descendant``. Chosen nodes that are not in the document have no rows.
    """
    picked = chosen.select("query_id", "doc_id", "node_id").distinct()
    anchors = picked.join(places.select("doc_id", "node_id", F.col("place").alias("first"), "last"), ["doc_id", "node_id"])
    asked = united(anchors, ["query_id", "doc_id"]).select("query_id", "doc_id", F.explode(F.sequence("first", "last")).alias("place"))
    met = asked.join(places.select("doc_id", "place", "node_id"), ["doc_id", "place"])
    named = met.join(picked.withColumn("_own", F.lit(True)), ["query_id", "doc_id", "node_id"], "left")
    return named.select("query_id", "doc_id", "node_id", "place", F.when(F.col("_own"), "selected_node").otherwise("descendant").alias("reason"))


def scope_summary(places: DataFrame, chosen: DataFrame) -> DataFrame:
    """What each query's choice takes in: ``query_id, doc_id, modules, descendants, pages, blocks, boundaries, missing``.

    ``places`` also has ``first_page, last_page, first_block, last_block`` of each
    node, null where it has none. ``pages`` are intervals in order, united where
    they touch, ``blocks`` counts blocks in united intervals, ``boundaries`` are
    the nodes at which scopes end, in order, and ``missing`` counts chosen nodes
    that the document has not.
    """
    rows = scope_rows(places, chosen)
    keys = ["query_id", "doc_id"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("modules"), F.sum((F.col("reason") == "descendant").cast("long")).alias("descendants"))
    held = rows.select(*keys, "place").join(places.select("doc_id", "place", "first_page", "last_page", "first_block", "last_block"), ["doc_id", "place"])
    spans = held.select(*keys, F.explode(F.array(F.struct(F.lit("page").alias("kind"), F.col("first_page").cast("long").alias("first"), F.col("last_page").cast("long").alias("last")), F.struct(F.lit("block").alias("kind"), F.col("first_block").cast("long").alias("first"), F.col("last_block").cast("long").alias("last")))).alias("s"))
    whole = united(spans.select(*keys, "s.*"), [*keys, "kind"], touching=1)
    page = F.col("kind") == "page"
    taken = whole.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(page, F.struct("first", "last")))).alias("pages"), F.sum(F.when(~page, F.col("last") - F.col("first") + 1)).alias("blocks"))
    known = chosen.select(*keys, "node_id").distinct().join(places.select("doc_id", "node_id", "last", "end_node", F.lit(True).alias("_there")), ["doc_id", "node_id"], "left")
    ends = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("end_node").isNotNull(), F.struct("last", "end_node")))), lambda x: x["end_node"]))
    asked = known.groupBy(*keys).agg(ends.alias("boundaries"), F.sum(F.col("_there").isNull().cast("long")).alias("missing"))
    out = asked.join(counts, keys, "left").join(taken, keys, "left")
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return out.select(*keys, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("modules", "descendants")], F.coalesce("pages", none).alias("pages"), F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"), "boundaries", "missing")


def budgeted(items: DataFrame, keys: list[str], order: list[str], cost: str, budget: int, given: str = "given") -> DataFrame:
    """Items that still get something of their group's budget, in order, with what that is: all of their cost, or for the last one what is left.

    Costs are whole and positive; items without one go. As each takes one at least,
    no item beyond ``budget`` places can get anything. Up to a thousand places
    (``spark.sql.optimizer.windowGroupLimitThreshold``) Spark drops the rest before
    rows are exchanged, so that a group of any size is ``budget`` rows a task.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    first = items.where(F.col(cost) > 0).withColumn("_place", F.row_number().over(ordered)).where(F.col("_place") <= budget).drop("_place")
    before = F.coalesce(F.sum(cost).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn(given, F.least(F.col(cost), F.lit(budget) - before)).where(F.col(given) > 0)


def row_budget(blocks: DataFrame, budget: int = ROWS) -> DataFrame:
    """Blocks of each document under one budget of table rows, with the rows ``kept`` and whether they were ``cut``.

    ``blocks`` has ``doc_id, ord`` (no two alike in a document) and ``rows``,
    null for a block that is no table: those stay. Tables keep their rows in
    order until the budget is spent; the one it ends in keeps what is left, and
    tables behind it and those without rows go.
    """
    tables = budgeted(blocks.where(F.col("rows").isNotNull()), ["doc_id"], ["ord"], "rows", budget, "kept").withColumn("cut", F.col("kept") < F.col("rows"))
    texts = blocks.where(F.col("rows").isNull()).withColumn("kept", F.lit(None).cast(dict(tables.dtypes)["kept"])).withColumn("cut", F.lit(False))
    return tables.unionByName(texts)


def _headed(number: Column, title: Column) -> Column:
    before, between = HEADING.split("{}")[:2]
    return F.concat(F.lit(before), number.cast("string"), F.lit(between), title)


def source_texts(scopes: DataFrame, modules: DataFrame, most: int = MODULE_SIGNS, whole: int = SOURCE_SIGNS) -> DataFrame:
    """The text that each query's scope gives to extract from: ``query_id, modules, source_text``.

    ``scopes`` is what ``scope_rows`` gives, ``modules`` has ``doc_id, node_id,
    title`` and ``input``. Modules are numbered in the order of the document; a
    module's text ends after ``most`` signs, the whole after ``whole``, blank
    lines between modules not counted, each cut with a line that says so. Lengths are
    summed first, and only texts that still fit are joined. Nodes without a
    module count, under their name, and have no text.
    """
    text = _stripped(F.coalesce("input", F.lit("")))
    brief = modules.select("doc_id", "node_id", F.coalesce(F.nullif(_stripped(F.col("title")), F.lit("")), F.col("node_id").cast("string")).alias("title"), F.length(text).alias("_n"))
    sized = scopes.select("query_id", "doc_id", "node_id", "place").join(brief, ["doc_id", "node_id"], "left").withColumn("title", F.coalesce("title", F.col("node_id").cast("string")))
    numbered = sized.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "place")))
    counts = scopes.groupBy("query_id").agg(F.count("*").alias("modules"))
    heading = _headed(F.col("number"), F.col("title"))
    size = F.when(F.col("_n") > most, most + len(MODULE_CUT)).otherwise(F.coalesce("_n", F.lit(0)))
    costed = numbered.withColumn("heading", heading).withColumn("_cost", (F.length(heading) + F.when(size > 0, size + 1).otherwise(0)).cast("int"))
    fit = budgeted(costed, ["query_id"], ["number"], "_cost", whole).select("query_id", "doc_id", "node_id", "number", "heading", "_cost", "given")
    body = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(MODULE_CUT))).otherwise(text)
    full = fit.join(modules.select("doc_id", "node_id", body.alias("body")), ["doc_id", "node_id"], "left")
    part = F.concat_ws("\n", "heading", F.nullif("body", F.lit("")))
    part = F.when(F.col("given") < F.col("_cost"), F.concat(F.substring(part, F.lit(1), F.col("given")), F.lit(SOURCE_CUT))).otherwise(part)
    joined = full.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", part.alias("part")))).alias("parts"))
    return counts.join(joined.select("query_id", _stripped(F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n")).alias("source_text")), "query_id")


def whole_texts(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """The whole texts of named modules in the order they were named: ``query_id, whole_text``.

    ``wanted`` has ``query_id, doc_id, node_id`` and ``number`` (from 1); a module
    that the document has not, or without text, keeps its number free.
    """
    text = _stripped(F.coalesce("input", F.lit("")))
    name = F.coalesce(F.nullif(_stripped(F.col("title")), F.lit("")), F.col("node_id").cast("string"))
    met = wanted.join(modules.select("doc_id", "node_id", name.alias("title"), text.alias("text")), ["doc_id", "node_id"]).where("text <> ''")
    part = F.struct("number", F.concat(_headed(F.col("number"), F.col("title")), F.lit("\n"), F.col("text")).alias("part"))
    joined = met.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return joined.select("query_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("whole_text"))


def hydrated(sources: DataFrame, wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """Sources that carry a preview only, with the whole text of their modules in its place: ``hydrated`` says why or why not.

    ``sources`` has ``query_id, source_text``. A text that says it was cut, or is
    shorter by more than 200 signs, is replaced (``used``); else it stays as
    ``complete``, or as ``not_found`` where no module has a text.
    """
    found = sources.join(whole_texts(wanted, modules), "query_id", "left")
    now = _stripped(F.coalesce("source_text", F.lit("")))
    preview = F.lit(False)
    for mark in CUT_MARKS:
        preview = preview | F.contains(now, F.lit(mark))
    longer = F.length("whole_text") > F.length(now) + LONGER
    why = F.when(F.col("whole_text").isNull(), "not_found").when(preview | longer, "used").otherwise("complete")
    return found.withColumn("hydrated", why).withColumn("source_text", F.when(F.col("hydrated") == "used", F.col("whole_text")).otherwise(F.col("source_text"))).drop("whole_text")
