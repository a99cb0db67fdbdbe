"""Rows of mixed extraction objects: collected, projected onto headers, exported, and dispatched to executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.predicates import kept_values
from leafline.operators import rules as R


def collected_rows(snapshots: DataFrame, fields: list[str] | None = None, skip_empty: bool = True) -> DataFrame:
    """Rows of a document's objects in order: ``doc_id, row_no`` (from 1) and ``values``, a map.

    ``snapshots`` has ``doc_id, ord, kind`` and, by kind, ``label, value`` (a
    field), ``headers, rows`` (a table) or ``kv, components`` (an object, its
    pairs before its component rows). All fields make one row, the first; of
    fields with one label the last counts. Rows left without values go.
    """
    held = snapshots.withColumn("doc", F.col("doc_id"))
    label = F.trim("label")
    wanted = (label != "") & (label.isin(*fields) if fields else F.lit(True)) & ((F.coalesce(F.trim("value"), F.lit("")) != "") if skip_empty else F.lit(True))
    single = held.where((F.col("kind") == "field") & wanted).groupBy("doc_id", label.alias("key")).agg(F.max(F.struct("ord", F.trim("value").alias("v"))).alias("b"), F.min("ord").alias("o"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("o", "key", F.col("b.v").alias("v")))), lambda x: F.struct(x["key"].alias("key"), x["v"].alias("value")))
    first = single.groupBy("doc_id").agg(F.map_from_entries(pairs).alias("values")).select("doc_id", F.lit(-1).cast("long").alias("ord"), F.lit(0).alias("i"), "values")

    def row_of(headers: Column, cells: Column) -> Column:
        # of a header used twice the last column counts
        last = F.filter(F.transform(headers, lambda h, i: F.struct(F.trim(h).alias("key"), F.trim(F.coalesce(F.get(cells, i), F.lit(""))).alias("value"), i.alias("i"))), lambda x: x["key"] != "")
        kept = F.filter(last, lambda x: ~F.exists(last, lambda y: (y["key"] == x["key"]) & (y["i"] > x["i"])))
        return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))

    tables = held.where("kind = 'table'").select("doc_id", "ord", "headers", F.posexplode("rows").alias("i", "cells")).select("doc_id", "ord", "i", row_of(F.col("headers"), F.col("cells")).alias("values"))
    none = F.array().cast("array<map<string,string>>")
    parts = F.concat(F.when(F.col("kv").isNotNull(), F.array("kv")).otherwise(none), F.coalesce("components", none))
    objects = held.where("kind = 'object'").select("doc_id", "ord", F.posexplode(parts).alias("i", "values"))
    rest = tables.unionByName(objects).select("doc_id", "ord", "i", kept_values(F.col("values"), fields, skip_empty).alias("values")).where(F.size("values") > 0)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "i"))
    return first.unionByName(rest).select("doc_id", number.alias("row_no"), "values")


def headers_of(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The headers of each document: the configured fields that any row has, else all keys as they first occur."""
    keys = rows.select("doc_id", "row_no", F.posexplode(F.map_keys("values")).alias("i", "header"))
    first = keys.groupBy("doc_id", "header").agg(F.min(F.struct("row_no", "i")).alias("o"))
    order = F.col("o")
    if fields:
        place = F.array_position(F.array(*map(F.lit, fields)), F.col("header"))
        chosen = first.withColumn("p", place)
        has = F.max(F.when(F.col("p") > 0, 1).otherwise(0)).over(Window.partitionBy("doc_id"))
        first = chosen.withColumn("has", has).where("has = 0 or p > 0")
        order = F.when(F.col("has") == 1, F.struct(F.lit(0).alias("row_no"), F.col("p").cast("int").alias("i"))).otherwise(F.col("o"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    return first.select("doc_id", number.alias("header_no"), "header")


def extracted(rows: DataFrame, fields: list[str] | None = None, drop_blank: bool = True) -> DataFrame:
    """A row for each value under the headers: ``doc_id, row_no, header_no, header, value``; blank rows go unless kept."""
    held = rows.join(headers_of(rows, fields), "doc_id").withColumn("value", F.coalesce(F.element_at("values", F.col("header")), F.lit("")))
    if drop_blank:
        filled = F.max(F.when(F.trim("value") != "", 1).otherwise(0)).over(Window.partitionBy("doc_id", "row_no"))
        held = held.withColumn("filled", filled).where("filled = 1")
    return held.select("doc_id", "row_no", "header_no", "header", "value")


def exported(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Rows as text columns under ``headers``, as they are written for a download."""
    return rows.orderBy("doc_id", "row_no").select(*[F.coalesce(F.element_at("values", F.lit(h)), F.lit("")).alias(h) for h in headers])


def write_export(rows: DataFrame, headers: list[str], path: str) -> None:
    """``exported`` rows as CSV files with a header line each."""
    exported(rows, headers).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def instructed(records: DataFrame, fields: list[str], instruction: str) -> DataFrame:
    """``records`` with the mappings that an instruction's lines name; lines without one say nothing."""
    rule = R.Rule("exact_mapping", tuple(fields), mappings=R.parsed_rules(instruction))
    return R.apply(records, fields, [rule] if rule.mappings else [])


#: What a skill may be carried out by; outside services are ports.
EXECUTORS: dict[str, Callable[..., DataFrame]] = {
    "local_transform": lambda rows, config: R.apply(rows, config["fields"], config["rules"]),
    "local_instruction": lambda rows, config: instructed(rows, config["fields"], config["instruction"]),
    "export_data": lambda rows, config: exported(rows, config["headers"]),
    "quality_check": lambda rows, config: R.quality(rows, config["key"], config.get("required", []), config.get("patterns", {}), config.get("unique", [])),
}


def dispatched(rows: DataFrame, executor: str, config: dict) -> DataFrame:
    """``rows`` by the executor of that name; others are refused."""
    if executor not in EXECUTORS:
        raise ValueError(f"no executor {executor}")
    return EXECUTORS[executor](rows, config)
