"""Predicates over rows of cells, blocks, skills and candidates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafline.functions.text import spaces

#: Kinds of blocks by way of reading them, and terms of warnings that block.
TEXT_KINDS = ("text", "title", "paragraph", "list", "header")
TABLE_KINDS = ("table", "table_body")
BLOCKING_TERMS = ("空表格", "无明细", "仅包含头部", "缺少具体", "结构不完整")


def clean(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))


def some(cells: Column) -> Column:
    return F.filter(clean(cells), lambda c: c != "")


def of_mode(kind: Column, mode: str) -> Column:
    """Whether a block is read as ``text`` or as ``table``."""
    return F.lower(F.coalesce(kind, F.lit(""))).isin(*(TABLE_KINDS if mode == "table" else TEXT_KINDS))


def detail_row(cells: Column) -> Column:
    """A numbered row with three cells or more that hold text."""
    return F.coalesce(F.get(clean(cells), F.lit(0)), F.lit("")).rlike(r"^[0-9]+(\.0+)?$") & (F.size(some(cells)) >= 3)


def context_row(cells: Column) -> Column:
    """A row with text that is no detail row."""
    return (F.size(some(cells)) > 0) & ~detail_row(cells)


def business_row(cells: Column) -> Column:
    """A row that looks like data: it begins with a number, or half its cells, two at least, have digits."""
    digits = F.size(F.filter(cells, lambda c: F.coalesce(c, F.lit("")).rlike("[0-9]")))
    first = F.coalesce(F.get(clean(cells), F.lit(0)), F.lit(""))
    return (F.size(cells) > 0) & (first.rlike("^[0-9]+$") | (digits >= F.greatest(F.lit(2), F.floor(F.size(cells) / 2))))


def row_signature(cells: Column) -> Column:
    return F.transform(clean(cells), lambda c: F.lower(F.regexp_replace(spaces(c), r"\s+", " ")))


def skipped_row(cells: Column, header: Column | None = None) -> Column:
    """Whether a row holds no record: blank, the header again, or two values at most of which one fills half the row, three cells at least."""
    held = some(cells)
    kinds = F.array_distinct(held)
    most = F.coalesce(F.array_max(F.transform(kinds, lambda k: F.size(F.filter(held, lambda c: c == k)))), F.lit(0))
    out = (F.size(held) == 0) | ((F.size(kinds) <= 2) & (most >= F.greatest(F.lit(3), F.floor(F.size(held) / 2))))
    return out if header is None else out | F.coalesce(row_signature(cells) == row_signature(header), F.lit(False))


def kept_values(row: Column, fields: list[str] | None = None, skip_empty: bool = True) -> Column:
    """A row's values (a map) of the chosen fields, all of them if none are named, without empty ones."""

    def keeps(key: Column, value: Column) -> Column:
        chosen = key.isin(*fields) if fields else F.lit(True)
        return chosen & (F.coalesce(value, F.lit("")) != "") if skip_empty else chosen

    return F.map_filter(row, keeps)


def raw_markup(text: Column) -> Column:
    """Whether a text is markup or an asset written into it."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("<table|<img|data:image|base64,")


def blocking(warnings: Column) -> Column:
    """Whether any warning says that a table has nothing to read."""
    return F.exists(warnings, lambda w: F.coalesce(w, F.lit("")).rlike("|".join(BLOCKING_TERMS)))


def published(version: Column, scope: Column, wanted_scope: str, customer: Column, customers: list[int]) -> Column:
    """Whether a skill has a published version of the scope that one of the customers sees; without customer all do."""
    return version.isNotNull() & (scope == wanted_scope) & (customer.isNull() | customer.isin(*customers))
