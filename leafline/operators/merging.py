"""Results merged over chunks: first values, decisions, issues, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_unique(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Trimmed non-empty values of each group where each first occurs, with their place."""
    held = rows.withColumn("v", F.trim(value)).where("v <> ''")
    first = held.groupBy(group, "v").agg(F.min(F.struct(*order)).alias("o"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("o"))
    return first.select(group, place.alias("place"), F.col("v").alias("value"))


def first_filled(rows: DataFrame, group: str, order: list[str], values: list[str]) -> DataFrame:
    """For each of ``values`` the first non-empty one of each group."""

    def first(c: str) -> Column:
        some = F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.struct(*order, F.col(c).alias("_v")))
        return F.min(some)["_v"].alias(c)

    return rows.groupBy(group).agg(*[first(c) for c in values])


def chunk_rows(rows: DataFrame) -> DataFrame:
    """Rows that overlap chunks sent twice, once: the lowest chunk's copy of each anchor and row."""
    best = F.min(F.struct("chunk", "text"))
    return rows.groupBy("group_id", "anchor", "row_index").agg(best.alias("b")).select("group_id", "anchor", "row_index", F.col("b.text").alias("text"))


def decisions(rows: DataFrame) -> DataFrame:
    """Rows folded by their decision: keep begins one, merge_prev joins the one before, skip goes.

    A merge before any kept row begins one of its own.
    """
    kept = rows.where(F.col("decision") != "skip")
    order = Window.partitionBy("group_id").orderBy("ord")
    starts = F.when((F.col("decision") == "keep") | (F.row_number().over(order) == 1), 1).otherwise(0)
    held = kept.withColumn("starts", starts).withColumn("record", F.sum("starts").over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    # text that a record already has is not added again
    return held.groupBy("group_id", "record").agg(F.min("ord").alias("ord"), F.count("*").alias("parts"), F.array_join(F.array_distinct(parts), "\n").alias("text"))


#: Issue levels from the gravest.
LEVELS = {"risk": 4, "attention": 3, "passed": 2, "open": 1}


def issues(rows: DataFrame) -> DataFrame:
    """One issue for each group and title: the most specific, then gravest, then longest, then first."""
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("level")]
    best = F.max(F.struct(F.col("specificity").alias("s"), level.alias("l"), F.length("detail").alias("n"), (-F.col("ord")).alias("o"), "level", "detail"))
    held = rows.groupBy("group_id", F.lower(F.trim("title")).alias("title")).agg(best.alias("b"), F.count("*").alias("merged"))
    return held.select("group_id", "title", F.col("b.level").alias("level"), F.col("b.detail").alias("detail"), "merged")


def issue_summary(merged: DataFrame) -> DataFrame:
    """The gravest level of each group, and how many issues of each level."""
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("level")]
    name = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in reversed(pair)])
    counts = F.concat_ws(" ", *[F.concat(F.lit(f"{x}:"), F.sum((F.col("level") == x).cast("int")).cast("string")) for x in LEVELS])
    return merged.groupBy("group_id").agg(name[F.max(level)].alias("level"), counts.alias("summary"))


def overridden(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with rows of ``override`` in place of those of the same key, and its others added."""
    both = base.select("*", F.lit(0).alias("_o")).unionByName(override.select("*", F.lit(1).alias("_o")))
    rest = [c for c in base.columns if c not in keys]
    best = F.max(F.struct("_o", *rest))
    return both.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """All expected labels with their actual value, empty where there is none."""
    return expected.join(actual, keys, "left").fillna("")


def compared(expected: DataFrame, actual: DataFrame, keys: list[str], expected_value: str, actual_value: str) -> DataFrame:
    """Expected and actual values side by side, those that only one side has too, with ``state``: same, changed, missing or extra."""
    met = expected.select(*keys, F.col(expected_value).alias("expected"), F.lit(True).alias("_e")).join(actual.select(*keys, F.col(actual_value).alias("actual"), F.lit(True).alias("_a")), keys, "full")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("expected").eqNullSafe(F.col("actual")), "same").otherwise("changed")
    return met.select(*keys, "expected", "actual", state.alias("state"))


def absent(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that nothing has."""
    return expected.join(actual, keys, "left_anti")


#: How a header continues another.
WIDTH_APART, HEADER_LIKE, LEAST_TABLES, LEAST_ROWS = 2, 0.45, 3, 3


def detail_row(cells: Column) -> Column:
    """Whether a row is numbered and has three cells or more with text."""
    first = F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))
    return first.rlike(r"^[0-9]+(\.0+)?$") & (F.size(filled(cells)) >= 3)


def filled(cells: Column) -> Column:
    return F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")


def header_keys(cells: Column) -> Column:
    """Distinct headers in lower case, word signs and CJK alone."""
    keys = F.transform(cells, lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-zA-Z_À-ɏ一-鿿]+", ""))
    return F.array_distinct(F.filter(keys, lambda c: c != ""))


def generic_headers(cells: Column) -> Column:
    """Whether there are headers and all are a column's number."""
    some = filled(cells)
    return (F.size(some) > 0) & F.forall(some, lambda c: c.rlike("^列[0-9]+$"))


def header_similarity(left: Column, right: Column) -> Column:
    """Share of ``left``'s headers that ``right`` has, those that hold or are held by one of its others half."""
    a, b = header_keys(left), header_keys(right)
    exact = F.size(F.array_intersect(a, b))
    held = F.size(F.filter(F.array_except(a, b), lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise((exact + held * 0.5) / F.greatest(F.size(a), F.lit(1)))


def _with_header_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``detail`` and ``head``, the first row of its table that heads numbered ones: its index and cells.

    It is among the first eight, has three cells or more with text of which
    less than half are numbers and six in ten differ, and a detail row follows
    within three.
    """
    whole = Window.partitionBy("doc_id", "table_no")
    some = filled(F.col("cells"))
    number = lambda c: F.regexp_replace(c, r"[,\s￥¥$%]", "").rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$")
    keyed = F.filter(F.transform(some, lambda c: F.regexp_replace(F.lower(c), r"[^0-9a-zA-Z_À-ɏ一-鿿]+", "")), lambda c: c != "")
    heads = (F.size(some) >= 3) & ~F.col("detail") & (F.size(F.filter(some, number)) * 2 < F.size(some)) & (F.size(F.array_distinct(keyed)) * 10 >= F.size(keyed) * 6) & (F.size(keyed) > 0)
    held = rows.withColumn("detail", detail_row(F.col("cells")))
    held = held.withColumn("follows", F.max(F.col("detail").cast("int")).over(whole.orderBy("row_index").rowsBetween(1, 3)))
    found = F.when((F.col("row_index") < 8) & (F.col("follows") == 1) & heads, F.struct("row_index", "cells"))
    return held.withColumn("head", F.min(found).over(whole)).drop("follows")


def _judged(tables: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """Rows of documents of ``least`` tables or more with ``detail``, ``header_row, anchor_headers`` and ``included``, by the rule of ``continuations``.

    A document's headers come to its rows as one map, so that all that follows is
    a window within the document: rows are exchanged once, by document.
    """
    listed = tables.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("table_no", "headers"))).alias("listed"), F.count("*").alias("t"))
    held = rows.join(listed.where(F.col("t") >= least), "doc_id").where(F.map_contains_key("listed", F.col("table_no")))
    held = _with_header_rows(held.withColumn("headers", F.col("listed")[F.col("table_no")]).drop("listed", "t"))
    whole = Window.partitionBy("doc_id", "table_no")
    held = held.withColumn("row_width", F.max(F.size("cells")).over(whole)).withColumn("numbered", F.max(F.when(F.col("row_index") < 5, F.col("detail").cast("int"))).over(whole))
    own = F.coalesce("head.cells", "headers", F.array().cast("array<string>"))
    held = held.withColumn("own", F.transform(own, lambda c: F.trim(F.coalesce(c, F.lit("")))))
    heads = F.col("head").isNotNull() | ((F.size("own") > 0) & ~generic_headers(F.col("own")))
    anchor = F.min(F.when(heads, F.struct("table_no", "own"))).over(Window.partitionBy("doc_id"))
    met = held.withColumn("anchor", anchor).where(F.col("anchor").isNotNull()).withColumn("anchor_headers", F.col("anchor.own"))
    some, wide = filled(F.col("own")), F.size(filled(F.col("anchor_headers")))
    width = F.greatest(F.size(some), "row_width")
    near = (wide == 0) | (width == 0) | (F.abs(width - wide) <= WIDTH_APART)
    named = (F.size(some) > 0) & ~generic_headers(some) & ~detail_row(some)
    like = F.when(named, header_similarity(F.col("anchor_headers"), some) >= HEADER_LIKE).otherwise(F.col("numbered") == 1)
    # headers are compared once a table, at its first row
    told = F.when(F.col("row_index") == F.col("top"), (F.col("table_no") < F.col("anchor.table_no")) | (near & like))
    met = met.withColumn("top", F.min("row_index").over(whole)).withColumn("told", told).withColumn("included", F.max("told").over(whole))
    return met.select("doc_id", "table_no", "row_index", "cells", "detail", F.col("head.row_index").alias("header_row"), "anchor_headers", "included")


def continuations(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Whether each table of a document continues its first headed one.

    ``tables`` has ``doc_id, table_no, headers`` (array), ``rows`` ``doc_id,
    table_no, row_index`` (from 0) and ``cells``. The anchor is the first table
    with a header row of its own or headers that are more than numbers. Tables
    before it count as they are; of it and the later ones those whose width is
    within two of the anchor's and whose headers are like its own, or that have
    none and begin with numbered rows. Returns ``doc_id, table_no, header_row,
    anchor_headers, included``; tables without rows are left out.
    """
    judged = _judged(tables, rows, 1).groupBy("doc_id", "table_no").agg(F.first(F.struct("header_row", "anchor_headers", "included")).alias("x"))
    return judged.select("doc_id", "table_no", "x.*")


def consolidated(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Detail rows of each document's continuing tables as one table, padded to one width.

    Returns ``doc_id, place`` (from 0), ``table_no, row_index, cells`` for
    documents of three tables or more that give three detail rows or more of
    two columns or more.
    """
    document = Window.partitionBy("doc_id")
    held = _judged(tables, rows, LEAST_TABLES).where(F.col("included") & F.col("detail") & (F.col("row_index") > F.coalesce("header_row", F.lit(-1))))
    held = held.withColumn("n", F.count("*").over(document)).withColumn("width", F.greatest(F.max(F.size("cells")).over(document), F.max(F.size("anchor_headers")).over(document)))
    wide = held.where((F.col("n") >= LEAST_ROWS) & (F.col("width") > 1))
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.trim(F.coalesce(F.get("cells", i), F.lit(""))))
    place = F.row_number().over(document.orderBy("table_no", "row_index")) - 1
    return wide.select("doc_id", place.cast("long").alias("place"), "table_no", "row_index", cells.alias("cells"))


def column_votes(values: DataFrame, cells: DataFrame) -> DataFrame:
    """For each field the column that holds most of its sample values; of equal columns the first.

    ``values`` has ``table_id, field, value``; ``cells`` ``table_id,
    column_index, value``.
    """
    votes = values.join(cells, ["table_id", "value"]).groupBy("table_id", "field", "column_index").agg(F.count("*").alias("votes"))
    best = F.max(F.struct("votes", (-F.col("column_index")).alias("c")))
    return votes.groupBy("table_id", "field").agg(best.alias("b")).select("table_id", "field", (-F.col("b.c")).alias("column_index"), F.col("b.votes").alias("votes"))
