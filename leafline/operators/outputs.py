"""Outputs of extraction: normal form, targets, checks, merges over chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import field_key, like_key

#: Kinds of outputs, kinds that hold rows, and limits of brief texts.
KINDS = ("field_list", "data_table", "kv_table", "kv_record_table", "record_collection", "custom")
ROW_KINDS = ("data_table", "record_collection")
MOST_BULLETS, MOST_ERRORS, BRIEF_TITLE, BRIEF_TEXT = 12, 20, 24, 12
LEVELS = {"high": "risk", "risk": "risk", "error": "risk", "medium": "attention", "warning": "attention", "attention": "attention", "ok": "passed", "pass": "passed", "passed": "passed"}


def normalised(outputs: DataFrame) -> DataFrame:
    """Outputs with what they lack filled in, and ``problem`` where their shape is not that of their kind.

    ``outputs`` has ``run_id, ord, output_id, kind, title, renderer, fields``
    (a map), ``headers`` and ``rows``. Ids count from ``output-1``; an unknown
    kind is custom.
    """
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("custom")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))

    def given(name: str, other: str) -> object:
        return F.coalesce(F.when(F.trim(name) != "", F.trim(name)), F.lit(other)).alias(name)

    held = outputs.withColumn("kind", kind).withColumn("n", place)
    problem = F.when((F.col("kind") == "field_list") & F.col("fields").isNull(), "no_fields").when(F.col("kind").isin(*ROW_KINDS) & F.col("rows").isNull(), "no_rows").when(F.col("kind").isin(*ROW_KINDS) & (F.coalesce(F.size("headers"), F.lit(0)) <= 0), "no_headers")
    name = F.coalesce(F.when(F.trim("output_id") != "", F.trim("output_id")), F.concat(F.lit("output-"), F.col("n").cast("string"))).alias("output_id")
    return held.select("run_id", "n", name, "kind", given("title", "output"), given("renderer", "auto"), "fields", "headers", "rows", problem.alias("problem"))


def targets(outputs: DataFrame) -> DataFrame:
    """What can be worked on of each output: itself, its fields, its table and its records, with their ids and labels."""
    own = outputs.select("run_id", F.concat(F.lit("output:"), "output_id").alias("target_id"), F.lit("output").alias("target_kind"), F.col("title").alias("label"))
    fields = outputs.where("kind = 'field_list'").select("run_id", "output_id", F.posexplode(F.map_keys("fields")).alias("i", "label"))
    fields = fields.select("run_id", F.concat_ws(":", F.lit("field"), "output_id", F.col("i").cast("string")).alias("target_id"), F.lit("field").alias("target_kind"), "label")
    tables = outputs.where(F.col("kind").isin(*ROW_KINDS) & F.col("problem").isNull())
    whole = tables.select("run_id", F.concat_ws(":", F.lit("table"), "output_id").alias("target_id"), F.when(F.col("kind") == "record_collection", "record_collection").otherwise("table").alias("target_kind"), F.concat_ws(" | ", "headers").alias("label"))
    records = tables.where("kind = 'record_collection'").select("run_id", "output_id", F.posexplode("rows").alias("i", "row"))
    records = records.select("run_id", F.concat_ws(":", F.lit("record"), "output_id", F.col("i").cast("string")).alias("target_id"), F.lit("record").alias("target_kind"), F.coalesce(F.get("row", F.lit(0)), F.lit("")).alias("label"))
    return own.unionByName(fields).unionByName(whole).unionByName(records)


def legacy_fields(outputs: DataFrame) -> DataFrame:
    """Fields of all field lists in order, as older readers take them."""
    return outputs.where("kind = 'field_list' and problem is null").select("run_id", "n", F.posexplode("fields").alias("i", "label", "value"))


def legacy_tables(outputs: DataFrame) -> DataFrame:
    """Tables and record collections with their size, as older readers take them."""
    return outputs.where(F.col("kind").isin(*ROW_KINDS) & F.col("problem").isNull()).select("run_id", "n", "title", F.size("headers").alias("columns"), F.size("rows").alias("rows"))


def partial_rows(outputs: DataFrame) -> DataFrame:
    """Record collections made from a part of their rows only, where no fast path read them all: ``run_id, missing``."""
    part = (F.col("kind") == "record_collection") & ~F.col("fast_path") & (F.col("selected_rows") < F.col("total_rows"))
    return outputs.where(part).select("run_id", "output_id", (F.col("total_rows") - F.col("selected_rows")).alias("missing"))


def operation_problems(results: DataFrame) -> DataFrame:
    """Why a result's payload is not of its kind: decision, object, table or text; empty where it is."""
    k = F.col("result_kind")
    problem = (
        F.when(F.coalesce(F.trim("summary"), F.lit("")) == "", "no_summary")
        .when((k == "decision") & (F.coalesce(F.trim("decision"), F.lit("")) == ""), "no_decision")
        .when((k == "object") & (F.coalesce(F.size("fields"), F.lit(0)) <= 0), "no_fields")
        .when((k == "table") & (F.coalesce(F.size("headers"), F.lit(0)) <= 0), "no_headers")
        .when((k == "text") & (F.coalesce(F.trim("text"), F.lit("")) == ""), "no_text")
        .when(~k.isin("decision", "object", "table", "text"), "unknown_kind")
        .otherwise("")
    )
    return results.select("result_id", problem.alias("problem"))


def normal_issues(issues: DataFrame) -> DataFrame:
    """Issues with one of four levels and brief texts; a passed one without text says so, an open one that it waits."""
    table = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    level = F.coalesce(table[F.lower(F.trim("level"))], F.lit("open"))
    held = issues.withColumn("level", level)
    text = F.coalesce(F.when(F.trim("text") != "", F.trim("text")), F.when(F.col("level") == "passed", "passed").when(F.col("level") == "open", "pending").otherwise(""))
    return held.select("issue_id", "level", F.substring(F.trim("title"), 1, BRIEF_TITLE).alias("title"), F.substring(text, 1, BRIEF_TEXT).alias("text"))


def merged_process(chunks: DataFrame) -> DataFrame:
    """Process results of a run's chunks as one: distinct texts with a blank line between, first summary, distinct bullets, type.

    ``chunks`` has ``run_id, ord, kind`` (transform or analysis), ``text,
    summary, bullets``. Of bullets the first twelve stay; of both kinds the type
    is mixed.
    """
    def listed(rows: DataFrame, most: int | None = None) -> DataFrame:
        first = rows.where("v <> ''").groupBy("run_id", "v").agg(F.min("o").alias("o"))
        values = F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"])
        return first.groupBy("run_id").agg((F.slice(values, 1, most) if most else values).alias("list"))

    texts = listed(chunks.select("run_id", F.struct("ord", F.lit(0).alias("i")).alias("o"), F.trim("text").alias("v")))
    bullets = chunks.select("run_id", "ord", F.posexplode("bullets").alias("i", "b")).select("run_id", F.struct("ord", "i").alias("o"), F.trim("b").alias("v"))
    points = listed(bullets, MOST_BULLETS).select("run_id", F.col("list").alias("points"))
    whole = chunks.groupBy("run_id").agg(F.min(F.when(F.trim("summary") != "", F.struct("ord", F.trim("summary").alias("s"))))["s"].alias("summary"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    kind = F.when(F.size("kinds") > 1, "mixed").otherwise(F.get("kinds", F.lit(0)))
    out = whole.join(texts, "run_id", "left").join(points, "run_id", "left")
    none = F.array().cast("array<string>")
    return out.select("run_id", kind.alias("kind"), F.coalesce("summary", F.lit("")).alias("summary"), F.array_join(F.coalesce("list", none), "\n\n").alias("text"), F.array_join(F.coalesce("points", none), "|").alias("bullets"))


def merged_extraction(chunks: DataFrame) -> DataFrame:
    """Fields of a run's chunks as one list a prompt: each label once, its first value that is not empty, in the order labels occur."""
    value = F.min(F.when(F.trim("value") != "", F.struct("ord", F.trim("value").alias("v"))))["v"]
    held = chunks.groupBy("run_id", "prompt", "label").agg(F.min("ord").alias("o"), value.alias("value"), F.countDistinct(F.when(F.trim("value") != "", F.trim("value"))).alias("values"))
    place = F.row_number().over(Window.partitionBy("run_id", "prompt").orderBy("o", "label"))
    return held.select("run_id", "prompt", place.alias("place"), "label", F.coalesce("value", F.lit("")).alias("value"), (F.col("values") > 1).alias("conflict"))


def preferred_tables(parser: DataFrame, model: DataFrame) -> DataFrame:
    """For each block the parser's table, unless the model's rows are preferred and there are any; pairs of both.

    ``parser`` has ``block_id, rows, pairs``, ``model`` also ``preferred``.
    """
    m = model.select("block_id", F.col("rows").alias("model_rows"), F.col("pairs").alias("model_pairs"), "preferred")
    met = parser.join(m, "block_id", "full")
    use = F.coalesce(F.col("preferred") & (F.col("model_rows") > 0), F.lit(False)) | F.coalesce(F.col("rows"), F.lit(0)).eqNullSafe(0)
    none = F.array().cast("array<string>")
    source = F.when(use & (F.coalesce("model_rows", F.lit(0)) > 0), "model").when(F.col("rows") > 0, "parser").otherwise("none")
    return met.select("block_id", source.alias("source"), F.when(source == "model", F.col("model_rows")).otherwise(F.coalesce("rows", F.lit(0))).alias("rows"), F.array_join(F.array_distinct(F.concat(F.coalesce("pairs", none), F.coalesce("model_pairs", none))), ",").alias("pairs"))


def moved(rows: DataFrame, moves: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with those of ``moves`` (``keys`` and ``new_scope``) under their new scope, and the moves that another row is in the way of."""
    asked = rows.join(moves, list(keys))
    rest = [k for k in keys if k != "scope"]
    taken = rows.select(F.col("scope").alias("new_scope"), *rest)
    conflicts = asked.join(taken, ["new_scope", *rest], "left_semi")
    good = asked.join(taken, ["new_scope", *rest], "left_anti")
    out = rows.join(good.select(*keys), list(keys), "left_anti").unionByName(good.drop("scope").withColumnRenamed("new_scope", "scope").select(*rows.columns))
    return out, conflicts.select(*keys, "new_scope")


def label_coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Of each group how many expected labels are there, which are not, and which more there are."""
    a = expected.groupBy("group_id").agg(F.collect_set("label").alias("e"))
    b = actual.groupBy("group_id").agg(F.collect_set("label").alias("a"))
    none = F.array().cast("array<string>")
    e, x = F.coalesce("e", none), F.coalesce("a", none)

    def text(values: object) -> object:
        return F.array_join(F.array_sort(values), ",")

    return a.join(b, "group_id", "full").select("group_id", F.size(F.array_intersect(e, x)).alias("covered"), text(F.array_except(e, x)).alias("missing"), text(F.array_except(x, e)).alias("extra"))


def overviews(outputs: DataFrame, errors: DataFrame) -> DataFrame:
    """Outputs of each run by kind, and its first errors in order, at most twenty."""
    kinds = outputs.groupBy("run_id").agg(*[F.sum((F.col("kind") == k).cast("int")).cast("long").alias(k) for k in KINDS])
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))
    first = errors.withColumn("p", place).where(F.col("p") <= MOST_ERRORS).groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "error"))), lambda x: x["error"]), "|").alias("errors"))
    return kinds.join(first, "run_id", "left").fillna("", ["errors"])


def _key(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "^[:：]+|[:：]+$", "")


def decision_pairs(decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys and values that row decisions give, each once an anchor, in order: ``group_id, place, key, value, anchor``.

    ``decisions`` has ``group_id, ord, decision, anchor, row_index, pairs`` (array
    of key, value), ``label, values``; ``rows`` ``group_id, anchor, row_index,
    cells``. A decision that is not skip gives its own pairs; without any, the
    cells of its row by turns, where all keys look like keys; else its label
    with its one value, unless they say the same.
    """
    asked = decisions.where("decision <> 'skip'")
    by_anchor = rows.where("anchor <> ''").groupBy("group_id", "anchor").agg(F.max_by("cells", "row_index").alias("a"))
    by_index = rows.where("row_index > 0").groupBy("group_id", "row_index").agg(F.max_by("cells", "anchor").alias("b"))
    held = asked.join(by_anchor, ["group_id", "anchor"], "left").join(by_index, ["group_id", "row_index"], "left")
    kind = "array<struct<key:string,value:string>>"
    none = F.array().cast(kind)

    def pair(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    own = F.filter(F.transform(F.coalesce("pairs", none), lambda p: pair(_key(p["key"]), F.trim(F.coalesce(p["value"], F.lit(""))))), lambda p: (p["key"] != "") & (p["value"] != ""))
    cells = F.filter(F.transform(F.coalesce("a", "b", F.array().cast("array<string>")), lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    held = held.withColumn("own", own).withColumn("cells", cells)
    n = F.size("cells")
    turns = F.when(n >= 2, F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda i: pair(_key(F.get("cells", i * 2)), F.get("cells", i * 2 + 1)))).otherwise(none)
    turned = F.when((n >= 2) & (n % 2 == 0) & F.forall(turns, lambda p: like_key(p["key"])), turns).otherwise(none)
    values = F.filter(F.transform(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    label = _key(F.col("label"))
    single = F.when(like_key(label) & (F.size(values) == 1) & (field_key(label) != field_key(F.get(values, F.lit(0)))), F.array(pair(label, F.get(values, F.lit(0))))).otherwise(none)
    found = held.withColumn("turned", turned).withColumn("single", single)
    chosen = F.when(F.size("own") > 0, F.col("own")).when(F.size("turned") > 0, F.col("turned")).otherwise(F.col("single"))
    flat = found.select("group_id", "ord", "anchor", F.posexplode(chosen).alias("i", "p"))
    first = flat.groupBy("group_id", F.col("p.key").alias("key"), F.col("p.value").alias("value"), "anchor").agg(F.min(F.struct("ord", "i")).alias("o"))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("o"))
    return first.select("group_id", place.alias("place"), "key", "value", "anchor")


def result_kinds(results: DataFrame) -> DataFrame:
    """The kind of a confirmed result: as it says, else by its shape: table, text, decision or object.

    ``results`` has ``result_id, said`` and ``body``, a map of JSON texts.
    """
    keys = F.map_keys("body")
    has = lambda name: F.array_contains(keys, name)
    lists = has("headers") & has("rows") & F.element_at("body", F.lit("headers")).startswith("[") & F.element_at("body", F.lit("rows")).startswith("[")
    shape = F.when(lists, "table").when(has("decision") & ~(has("text") & (F.size("body") <= 2)), "decision").when(has("text") & (F.size("body") <= 2), "text").when(F.size("body") > 0, "object").otherwise("")
    return results.select("result_id", F.when(F.trim("said").isin("decision", "object", "table", "text"), F.trim("said")).otherwise(shape).alias("result_kind"))


def payload_metrics(facts: DataFrame, shown: DataFrame) -> DataFrame:
    """What of a document's facts was shown: pages, blocks, tables, their rows in all and shown, and the longest table.

    Both have ``doc_id, page_no, block_no, rows`` (of a table, else null);
    ``shown`` is the part that was selected.
    """
    part = shown.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"), F.count("*").alias("blocks"), F.count("rows").alias("tables"), F.sum("rows").alias("rows"), F.max("rows").alias("most"))
    whole = facts.groupBy("doc_id").agg(F.sum("rows").alias("full_rows"))
    return whole.join(part, "doc_id", "left").fillna(0, ["pages", "blocks", "tables", "rows", "most", "full_rows"])
