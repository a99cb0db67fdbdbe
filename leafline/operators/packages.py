"""Packages of evidence: tables as text, fallbacks by step, comparisons and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import bound
from leafline.operators.tables import kind_starts, row_kinds, table_regions


def as_markdown(view: DataFrame, most: int = 12) -> DataFrame:
    """Records as Markdown tables of at most ``most`` rows, with a line that tells how many are left out."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("headers")))
    rows = F.array_join(F.transform(F.slice("records", 1, most), line), "\n")
    more = F.when(F.size("records") > most, F.concat(F.lit("\n("), (F.size("records") - most).cast("string"), F.lit(" more rows)"))).otherwise("")
    return view.select("table_id", F.concat(line(F.col("headers")), F.lit("\n"), rule, F.lit("\n"), rows, more).alias("markdown"))


def tree_text(nodes: DataFrame, preview: int = 60) -> DataFrame:
    """A line for each node: its title under four spaces a level, cut to a preview."""
    line = F.concat(F.repeat(F.lit("    "), F.col("level") - 1), F.substring("title", 1, preview))
    return nodes.select("doc_id", "ord", line.alias("line"))


def table_shapes(rows: DataFrame, signals: DataFrame) -> DataFrame:
    """The evidence shape of each table: complex, record, kv_or_field, mixed or table, and what it rests on.

    ``rows`` is a grid, ``signals`` has ``table_id, complex``. A row is like a
    field if a colon is in it or, in tables of up to 24 rows, if it has up to
    four cells with text of which one has up to twelve signs; it is repeated if
    four cells or more hold two values at most. ``record_like`` and
    ``field_like`` are the stricter tests for lists of fields.
    """
    some = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != "")
    colon = F.array_join(some, " ").rlike("[:：]")
    short = F.size(some).between(1, 4) & F.exists(some, lambda c: F.length(c) <= 12)
    marked = rows.select("table_id", F.size("cells").alias("cells"), F.size(some).alias("some"), colon.alias("colon"), short.alias("short"), ((F.size(some) >= 4) & (F.size(F.array_distinct(some)) <= 2)).alias("repeated"))
    held = marked.groupBy("table_id").agg(
        F.count("*").alias("row_count"), F.max("cells").alias("column_count"), F.sum("cells").alias("all_cells"), F.sum("some").alias("filled"), F.sum(F.col("repeated").cast("int")).alias("repeated_rows"),
        F.sum(F.col("colon").cast("int")).alias("colons"), F.sum((F.col("colon") | F.col("short")).cast("int")).alias("either"),
    )
    held = held.join(signals.select("table_id", "complex"), "table_id", "left").fillna(False, ["complex"])
    n, cols = F.col("row_count"), F.col("column_count")
    fields = F.when(n <= 24, F.col("either")).otherwise(F.col("colons"))
    large = (n >= 8) & (cols >= 3)
    base = F.when(large & (F.col("repeated_rows") < F.greatest(F.lit(3), F.floor(n / 2))), "record_table").when(fields >= F.least(F.lit(3), F.greatest(n, F.lit(1))), "kv_or_field_table").otherwise("table")
    shape = F.when(F.col("complex"), "complex_table").when(large & (fields > 0), "mixed_table").otherwise(base)
    empty = F.floor((F.col("all_cells") - F.col("filled")) * 10_000 / F.col("all_cells")).cast("long")
    return held.select("table_id", shape.alias("shape"), n.alias("row_count"), cols.alias("column_count"), fields.cast("long").alias("field_rows"), F.col("repeated_rows").cast("long").alias("repeated_rows"), empty.alias("empty_share"))


def segments(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Stretches of each table's rows in order: sections (titles), records and the rest as grid.

    ``rows`` is a grid; a row of one value over three cells or more is a title.
    """
    some = F.filter("cells", lambda c: F.trim(c) != "")
    title = (F.size(some) >= 3) & (F.size(F.array_distinct(some)) == 1)
    held = rows.join(regions.select("table_id", "header_start", "data_end"), "table_id", "left")
    kind = F.when(title, "section").when((F.col("row_index") > F.col("header_start")) & (F.col("row_index") <= F.col("data_end")), "records").otherwise("grid")
    order = Window.partitionBy("table_id").orderBy("row_index")
    marked = held.select("table_id", "row_index", kind.alias("kind"))
    marked = marked.withColumn("fresh", F.when(F.lag("kind").over(order) == F.col("kind"), 0).otherwise(1)).withColumn("segment", F.sum("fresh").over(order))
    return marked.groupBy("table_id", "segment").agg(F.first("kind").alias("kind"), F.min("row_index").alias("row_start"), F.max("row_index").alias("row_end"))


def table_segments(grids: DataFrame) -> DataFrame:
    """The ``segments`` of ``grids``, each table read and judged in its own row."""
    held = table_regions(grids, F.lit(True), "grid")
    held = held.select("table_id", row_kinds(F.col("grid"), F.col("best")).alias("kinds"))
    held = held.select("table_id", "kinds", kind_starts(F.col("kinds")).alias("starts"))
    found = F.transform("starts", lambda k, i: F.struct((i + 1).cast("long").alias("segment"), F.get("kinds", k).alias("kind"), (k + 1).alias("row_start"), F.coalesce(F.get("starts", i + 1), F.size("kinds")).alias("row_end")))
    # an inner explode brings a filter on its array, and all that makes the table be done again for it
    return held.select("table_id", F.explode_outer(found).alias("s")).where("s is not null").select("table_id", "s.segment", "s.kind", "s.row_start", "s.row_end")


def backfilled(layout: DataFrame, model: DataFrame) -> DataFrame:
    """Layout tables with the text of the model's tables of the same place on the page, where theirs is empty."""

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("page_no").orderBy("table_no")))

    other = placed(model).select("page_no", "place", F.col("html").alias("model_html"))
    held = placed(layout).join(other, ["page_no", "place"], "left")
    empty = F.coalesce(F.trim("html"), F.lit("")) == ""
    return held.select("page_no", "table_no", F.when(empty, F.col("model_html")).otherwise(F.col("html")).alias("html"), (empty & F.col("model_html").isNotNull()).alias("filled"))


def rebound(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """References with the block they mean: of the same id, else the first of the same page, else none."""
    exact = refs.join(blocks.select(F.col("block_id").alias("b"), F.col("block_id").alias("found")), F.col("ref_block") == F.col("b"), "left")
    first = blocks.groupBy("page_no").agg(F.min("block_id").alias("near"))
    held = exact.join(first, "page_no", "left")
    return held.select("ref_id", F.coalesce("found", "near").alias("block_id"), F.when(F.col("found").isNotNull(), "exact").when(F.col("near").isNotNull(), "page").otherwise("unmatched").alias("how"))


def carried(reviewed: DataFrame, previous: DataFrame) -> DataFrame:
    """Reviewed fields with the page of the previous field of the same label and value."""
    before = previous.groupBy("label", "value").agg(F.min("page_no").alias("source_page"))
    return reviewed.join(before, ["label", "value"], "left").select("field_id", "label", "value", "source_page")


def with_fallback(items: DataFrame, least: int, most: int) -> DataFrame:
    """Items of each group by the first step that gives enough: strong, in scope, then any, at most ``most``.

    ``items`` has ``group_id, item_id, strong, in_scope``.
    """
    step = F.when(F.col("strong"), 1).when(F.col("in_scope"), 2).otherwise(3)
    held = items.withColumn("step", step)
    counts = held.groupBy("group_id").agg(F.sum((F.col("step") == 1).cast("int")).alias("a"), F.sum((F.col("step") <= 2).cast("int")).alias("b"))
    last = F.when(F.col("a") >= least, 1).when(F.col("b") >= least, 2).otherwise(3)
    chosen = held.join(counts.select("group_id", last.alias("last")), "group_id").where("step <= last")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("step", "item_id"))
    return chosen.withColumn("place", place).where(F.col("place") <= most).select("group_id", "item_id", "step")


def nearest_anchor(items: DataFrame, within: int = 12) -> DataFrame:
    """How far each item is from the nearest anchor of its page, up to ``within``; null beyond."""
    # both frames run from the first row on: one that runs to the last is read anew for each row
    place = F.when(F.col("anchor"), F.col("ord"))
    before = F.max(place).over(Window.partitionBy("page_no").orderBy("ord"))
    after = F.min(place).over(Window.partitionBy("page_no").orderBy(F.desc("ord")))
    away = F.least(F.col("ord") - before, after - F.col("ord"))
    return items.select("page_no", "ord", F.when(away <= within, away).alias("distance"))


def roles(candidates: DataFrame) -> DataFrame:
    """The role of each candidate of a query by how much structure it shares with the best.

    The best by score is primary; of the others six shared tokens or four on a
    later page make a continuation, two a related one, fewer none.
    """
    best = candidates.groupBy("query_id").agg(F.max(F.struct("score", F.col("candidate_id").alias("id"), "page_no", "tokens")).alias("p"))
    held = candidates.join(best, "query_id")
    shared = F.size(F.array_intersect("tokens", F.col("p.tokens")))
    later = F.col("page_no") >= F.col("p.page_no")
    role = F.when(F.col("candidate_id") == F.col("p.id"), "primary").when((shared >= 6) | ((shared >= 4) & later), "continuation").when(shared >= 2, "related").otherwise("rejected")
    return held.select("query_id", "candidate_id", role.alias("role"))


def assigned(tables: DataFrame) -> DataFrame:
    """The column of each field: equal names before names that hold each other, longer before shorter.

    ``tables`` has ``table_id`` (a row each), ``fields`` and ``headers``, arrays
    of names. A column goes to the field that fits it best, then by name. Returns
    ``table_id, field, column_index`` (from 0), ``score`` of all fields, the last
    two null where a field has no column.
    """

    def best(field: Column, low: Column) -> Column:
        # what fits nowhere has a null score, which is the least; of equal scores the first column is best
        equal, within = 1000 + F.length(field), lambda h: 100 + F.least(F.length(field), h["n"])
        return F.array_max(F.transform("heads", lambda h: F.struct(F.when(low == h["low"], equal).when(F.contains(low, h["low"]) | F.contains(h["low"], low), within(h)).alias("score"), h["back"].alias("back"))))

    # a table is one row until its fields are listed: rows for each field and column would be sorted many times over
    heads = F.transform("headers", lambda h, i: F.struct(F.lower(h).alias("low"), F.length(h).alias("n"), (-i).alias("back")))
    held = tables.select("table_id", F.array_distinct("fields").alias("fields"), heads.alias("heads"))
    wishes = F.transform("fields", lambda f: F.struct(f.alias("field"), bound(F.lower(f), lambda low: best(f, low)).alias("best")))
    held = held.select("table_id", wishes.alias("wishes"))
    # an inner explode brings a filter on its array, which is pushed below what makes the tables distinct
    held = held.select("table_id", "wishes", F.explode_outer("wishes").alias("w")).where("w is not null")
    better = F.exists("wishes", lambda o: (o["best"]["back"] == F.col("w.best.back")) & ((o["best"]["score"] > F.col("w.best.score")) | ((o["best"]["score"] == F.col("w.best.score")) & (o["field"] < F.col("w.field")))))
    mine = F.when(F.col("w.best.score").isNotNull() & ~F.coalesce(better, F.lit(False)), F.col("w.best"))
    held = held.select("table_id", F.col("w.field").alias("field"), mine.alias("m"))
    return held.select("table_id", "field", (-F.col("m.back")).alias("column_index"), F.col("m.score").alias("score"))


def drafts(rows: DataFrame) -> DataFrame:
    """Drafts of one key as one: the preferred, else the newest, with the ids of the rest."""
    best = F.max(F.struct(F.col("preferred").cast("int").alias("p"), "updated_at", "draft_id")).alias("b")
    held = rows.groupBy("key").agg(best, F.array_sort(F.collect_set("draft_id")).alias("ids"))
    rest = F.filter("ids", lambda x: x != F.col("b.draft_id"))
    return held.select("key", F.col("b.draft_id").alias("draft_id"), F.array_join(F.transform(rest, lambda x: x.cast("string")), ",").alias("removed"))
