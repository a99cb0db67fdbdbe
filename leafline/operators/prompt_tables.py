"""Which table, header and view a prompt is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import match_key
from leafline.operators.tables import table_counts, undecided_regions

#: From which size on tables cost much, and the least score of a table with named fields.
COSTLY_ROWS, COSTLY_CELLS, COSTLY_PAGES, COSTLY_TEXT, LEAST_SCORE = 80, 500, 3, 6000, 2


def high_cost(tables: DataFrame) -> DataFrame:
    """Whether a document's tables together cost much to read.

    ``tables`` has ``doc_id, page_no, rows, columns, text_length``.
    """
    cells = F.col("rows") * F.greatest(F.col("columns"), F.lit(1))
    held = tables.groupBy("doc_id").agg(F.sum("rows").alias("rows"), F.sum(cells).alias("cells"), F.countDistinct("page_no").alias("pages"), F.max("text_length").alias("text"))
    costly = (F.col("rows") >= COSTLY_ROWS) | (F.col("cells") >= COSTLY_CELLS) | (F.col("pages") >= COSTLY_PAGES) | (F.col("text") >= COSTLY_TEXT)
    return held.select("doc_id", "rows", "cells", "pages", costly.alias("costly"))


def field_scores(blocks: DataFrame, fields: DataFrame) -> DataFrame:
    """How many of a prompt's fields each block names in its header or first rows, by any alias.

    ``blocks`` has ``prompt_id, block_id, words`` (array), ``fields``
    ``prompt_id, field, aliases`` (array). Aliases and words meet by equal keys.
    """
    asked = fields.select("prompt_id", "field", F.explode(F.array_distinct(F.transform(F.concat(F.array("field"), "aliases"), match_key))).alias("k")).where("k <> ''").distinct()
    held = blocks.select("prompt_id", "block_id", F.explode(F.array_distinct(F.transform("words", match_key))).alias("k")).where("k <> ''")
    found = held.join(asked, ["prompt_id", "k"]).groupBy("prompt_id", "block_id").agg(F.countDistinct("field").alias("score"))
    return blocks.select("prompt_id", "block_id").join(found, ["prompt_id", "block_id"], "left").fillna(0, ["score"])


def target_blocks(scores: DataFrame, explicit: DataFrame) -> DataFrame:
    """The tables a prompt is about: its only one, else those of the best score.

    With explicit fields the best has to reach two, else there are none; without,
    all stay where nothing scores. ``explicit`` has ``prompt_id, named``.
    """
    whole = Window.partitionBy("prompt_id")
    held = scores.join(explicit, "prompt_id").withColumn("best", F.max("score").over(whole)).withColumn("blocks", F.count("*").over(whole))
    best = F.col("score") == F.col("best")
    keep = (F.col("blocks") == 1) | F.when(F.col("named"), best & (F.col("best") >= LEAST_SCORE)).otherwise(best | (F.col("best") <= 0))
    return held.where(keep).select("prompt_id", "block_id", "score")


def chosen_headers(candidates: DataFrame) -> DataFrame:
    """The header of each table that matches most fields, a hundred each less its width; of equal ones the first, none that match nothing.

    ``candidates`` has ``table_id, ord, headers`` (array) and ``matched``.
    """
    score = F.col("matched") * 100 - F.size("headers")
    best = F.max(F.struct(score.alias("score"), (-F.col("ord")).alias("o"), "headers")).alias("b")
    return candidates.where((F.col("matched") > 0) & (score > 0)).groupBy("table_id").agg(best).select("table_id", F.col("b.score").alias("score"), (-F.col("b.o")).alias("ord"), F.col("b.headers").alias("headers"))


def display_views(grids: DataFrame) -> DataFrame:
    """Whether each table of ``grids`` is shown as records or as its grid.

    As its grid without records, where pairs in half the rows of up to eight
    columns are, and where it has merged cells and the records don't cover it.
    Tables without a filled row are left out. Where pairs decide, records are not looked for.
    """
    n = F.col("row_count")
    by_pairs = (F.col("pairs") > 0) & (F.col("pairs") >= F.greatest(F.lit(1), F.floor(n / 2))) & (F.col("max_width") <= 8)
    held = undecided_regions(table_counts(grids, 8).withColumn("by_pairs", F.coalesce(by_pairs, F.lit(False))), ~F.col("by_pairs"), "merged", "row_count", "by_pairs").where(n > 0)
    part = (F.col("merged") > 0) & ~((F.col("row_start") <= 1) & (F.col("row_end") >= n))
    return held.select("table_id", F.when(F.col("row_start").isNull() | F.col("by_pairs") | part, "grid").otherwise("records").alias("shown"))


def markdown_rows(texts: DataFrame, id_col: str = "id", text_col: str = "markdown") -> DataFrame:
    """Rows of Markdown tables: ``id, row_no`` (0 the header) and ``cells``; rules and lines without bars are left out."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    rows = lines.where(F.col("line").rlike(r"^\|.*\|$") & ~F.col("line").rlike(r"^\|(\s*:?-+:?\s*\|)+$"))
    inner = F.expr("substring(line, 2, length(line) - 2)")
    cells = F.transform(F.split(F.replace(inner, F.lit("\\|"), F.lit("\u0001")), r"\|"), lambda c: F.trim(F.replace(c, F.lit("\u0001"), F.lit("|"))))
    return rows.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("line_no")) - 1).alias("row_no"), cells.alias("cells"))


def request_chunks(rows: DataFrame, size: int = 3) -> DataFrame:
    """Requests of a few rows each for a model, with the table's header and the rows before and after: ``table_id, chunk, rows, before, after``."""
    by_row = Window.partitionBy("table_id").orderBy("row_index")
    text = F.array_join("cells", " | ")
    held = rows.select("table_id", "row_index", text.alias("t"), F.lag(text).over(by_row).alias("b"), F.lead(text).over(by_row).alias("a"), F.floor(F.col("row_index") / size).alias("chunk"))
    listed = F.array_sort(F.collect_list(F.struct("row_index", "t")))
    out = held.groupBy("table_id", "chunk").agg(listed.alias("x"), F.min_by("b", "row_index").alias("before"), F.max_by("a", "row_index").alias("after"))
    return out.select("table_id", "chunk", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("rows"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
