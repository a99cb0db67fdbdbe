"""Payload items as typed values, and records as light views."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import spaces

#: Keys of a result that are structure and no fields, and what a compacted scope may hold.
STRUCTURE_KEYS = (
    "rowDecisions", "rows", "canonicalTable", "kvPairs", "total_rows", "totalRows", "markdown_table", "markdownTable", "markdown", "table_markdown",
    "tableMarkdown", "table_data", "tableData", "parserVersion", "tableRole", "logicalGrid", "cellGrid", "cells", "segments", "displayTable", "parseWarnings",
)
MOST_REFS, MOST_TARGETS, MOST_TEXT = 24, 64, 420


def whole_number(text: Column) -> Column:
    """A written integer, null where it is none."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(text).try_cast("bigint"))


def page_of(item: Column, fallback_index: Column) -> Column:
    """The page of a JSON item: its index and one, else its positive number by any name, else the fallback index and one."""
    index = whole_number(F.get_json_object(item, "$.page_idx"))
    number = whole_number(F.coalesce(*[F.when(x.isNotNull() & (x != "") & (x != "0"), x) for x in (F.get_json_object(item, f"$.{k}") for k in ("page_no", "pageNo", "page"))]))
    return F.coalesce(index + 1, F.when(number > 0, number), fallback_index.cast("bigint") + 1)


def box_of(item: Column, pad: bool = False) -> Column:
    """The first four numbers of a JSON item's box; without four, or with others, none, or zeros if ``pad``."""
    values = F.from_json(F.get_json_object(item, "$.bbox"), "array<string>")
    four = F.transform(F.slice(values, 1, 4), lambda x: x.try_cast("double"))
    good = (F.size(values) >= 4) & ~F.exists(four, lambda x: x.isNull())
    none = F.array(*[F.lit(0.0)] * 4) if pad else F.array().cast("array<double>")
    return F.when(F.coalesce(good, F.lit(False)), four).otherwise(none)


def flat_text(item: Column) -> Column:
    """The text of a JSON string, list or object (its ``content``, else ``text``, else ``item_content``), parts joined by a space, however deep they lie."""

    def flat(value: object) -> str:
        if isinstance(value, dict):
            return flat(value.get("content") or value.get("text") or value.get("item_content"))
        if isinstance(value, list):
            return " ".join(x for x in map(flat, value) if x)
        return " ".join(value.replace("<|txt_split|>", "\n").split()) if isinstance(value, str) else ""

    def texts(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in values:
            yield part.map(lambda x: flat(json.loads(x) if x.startswith(("[", "{", '"')) else x), na_action="ignore").fillna("")

    return F.pandas_udf(texts, "string")(item)


def list_text(values: Column) -> Column:
    """Texts as numbered lines; empty ones keep their number and are left out."""
    lines = F.transform(values, lambda x, i: F.when(F.coalesce(F.trim(x), F.lit("")) != "", F.concat((i + 1).cast("string"), F.lit(". "), F.trim(x))))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def scalar_text(values: Column) -> Column:
    """Scalars as text joined by bars, nulls and empty ones left out."""
    return F.array_join(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), " | ")


def payload_size(*columns: str) -> Column:
    """Bytes of the columns as one JSON object."""
    return F.octet_length(F.to_json(F.struct(*columns)))


def scalar_fields(result: Column) -> Column:
    """The fields of a result (a map) that are no structure."""
    return F.map_filter(result, lambda k, v: ~k.isin(*STRUCTURE_KEYS))


def stripped(result: Column, keys: tuple[str, ...] = ("bbox", "polygon", "location"), masked: tuple[str, ...] = ("api_key", "token", "password")) -> Column:
    """A record (a map) without geometry, secrets masked, as it may be traced."""
    kept = F.map_filter(result, lambda k, v: ~F.lower(k).isin(*keys))
    return F.transform_values(kept, lambda k, v: F.when(F.lower(k).isin(*masked), F.lit("***")).otherwise(v))


def on_page(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """Both ends of a side as shares of the page: as they are up to 1.2, else divided by its size, kept between 0 and 1."""
    share = (low <= 1.2) & (high <= 1.2)

    def of(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(share, x).otherwise(x / size)))

    return of(low), of(high)


def compact_scope(refs: Column, targets: Column, text: Column) -> list[Column]:
    """References, targets and text cut to what a scope may hold."""
    return [F.slice(refs, 1, MOST_REFS).alias("refs"), F.slice(targets, 1, MOST_TARGETS).alias("targets"), F.substring(text, 1, MOST_TEXT).alias("text")]


def summaries(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """A line for each module: how many texts and tables it has, its first three texts and first two tables with their rows.

    ``texts`` has ``module_id, ord, text`` and ``tables`` ``module_id, ord,
    title, rows``. A text is cut to 80 signs; a table without title is 表格.
    """
    place = F.row_number().over(Window.partitionBy("module_id").orderBy("ord"))
    heads = texts.withColumn("p", place)
    line = F.when((F.col("p") <= 3) & (F.col("text") != ""), F.struct("p", F.substring("text", 1, 80).alias("t")))
    a = heads.groupBy("module_id").agg(F.count("*").alias("texts"), F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]).alias("a"))
    named = F.concat(F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "表格").otherwise(F.col("title")), F.lit("："), F.col("rows").cast("string"), F.lit(" 行"))
    b = tables.withColumn("p", place).groupBy("module_id").agg(F.count("*").alias("tables"), F.transform(F.array_sort(F.collect_list(F.when(F.col("p") <= 2, F.struct("p", named.alias("t"))))), lambda x: x["t"]).alias("b"))
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce("a", none), F.coalesce("b", none))
    counts = F.concat(F.coalesce("texts", F.lit(0)).cast("string"), F.lit(" 个文本节点，"), F.coalesce("tables", F.lit(0)).cast("string"), F.lit(" 个表格。"))
    return a.join(b, "module_id", "full").select("module_id", F.concat(counts, F.when(F.size(parts) > 0, F.concat(F.lit(" "), F.array_join(parts, " / "))).otherwise("")).alias("summary"))
