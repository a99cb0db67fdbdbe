"""Blocks, steps, outputs and evidence tied together."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_scores(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """How well each item fits each block of its page: ``page_no, item_id, block_id, score, overlap``.

    100 for the same kind; 120 for equal text, else 80 if one holds the other,
    else 60 by shared words against the longer one's; 40 by overlap of the
    boxes. Boxes are in thousandths, scores whole; ``overlap`` in millionths.
    Only the blocks of one page meet, whose number a page bounds.
    """
    def words(text: str) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(text), r"[^0-9a-z_À-ɏ一-鿿]+"), lambda w: w != ""))

    # below the join, so that a text is cut into words once and not for each pair
    met = items.withColumn("_iw", words("item_text")).join(blocks.withColumn("_bw", words("block_text")), "page_no")
    a, b = F.col("_iw"), F.col("_bw")
    ratio = F.coalesce(F.floor(F.try_divide(F.size(F.array_intersect(a, b)) * 60, F.greatest(F.size(a), F.size(b)))), F.lit(0))
    both = (F.length("item_text") > 0) & (F.length("block_text") > 0)
    text = F.when(~both, 0).when(F.col("item_text") == F.col("block_text"), 120).when(F.contains("item_text", "block_text") | F.contains("block_text", "item_text"), 80).otherwise(ratio)

    def side(low: str, high: str) -> Column:
        return F.greatest(F.lit(0), F.least(f"i{high}", f"b{high}") - F.greatest(f"i{low}", f"b{low}"))

    shared = (side("x0", "x1") * side("y0", "y1")).cast("long")
    area = (F.col("ix1") - F.col("ix0")) * (F.col("iy1") - F.col("iy0")) + (F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")) - shared
    part = F.when(area > 0, F.floor(shared * 40 / area)).otherwise(0)
    score = F.when(F.col("item_kind") == F.col("block_kind"), 100).otherwise(0) + text + part
    return met.select("page_no", "item_id", "block_id", score.cast("long").alias("score"), F.when(area > 0, F.floor(shared * 1_000_000 / area)).otherwise(0).cast("long").alias("overlap"))


def assigned_blocks(scores: DataFrame) -> DataFrame:
    """Items in order, each with the best block of its page that none before it took; those that fit none are left out.

    Of equal scores the larger overlap wins, then the first block. What one item
    takes decides what is left for the next, so a page is a group of its own.
    """

    def take(page: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for row in page.sort_values(["item_id", "score", "overlap", "block_id"], ascending=[True, False, False, True]).itertuples(index=False):
            if row.score > 0 and row.block_id not in taken and (not out or out[-1][1] != row.item_id):
                taken.add(row.block_id)
                out.append((row.page_no, row.item_id, row.block_id, row.score))
        return pd.DataFrame(out, columns=["page_no", "item_id", "block_id", "score"])

    return scores.groupBy("page_no").applyInPandas(take, "page_no long, item_id long, block_id long, score long")


def chosen_versions(applications: DataFrame, versions: DataFrame) -> DataFrame:
    """Each application with its requested version, else its draft, else its latest published one."""
    met = applications.join(versions, "application_id")
    rank = F.when(F.col("version") == F.col("requested"), 3).when(F.col("state") == "draft", 2).when(F.col("state") == "published", 1)
    best = F.max(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "version", "state")))
    found = met.groupBy("application_id").agg(best.alias("b"))
    return applications.select("application_id").join(found, "application_id", "left").select("application_id", F.col("b.version").alias("version"), F.col("b.state").alias("state"))


def step_inputs(steps: DataFrame) -> DataFrame:
    """Each step with how many inputs it names, how many are there, and whether it can begin.

    ``steps`` has ``run_id, step_id, output_key, input_keys`` (array) and ``status``.
    """
    asked = steps.select("run_id", "step_id", F.explode_outer("input_keys").alias("key"))
    made = steps.select("run_id", F.col("output_key").alias("key"), F.col("status").alias("made"))
    met = asked.join(made, ["run_id", "key"], "left")
    out = met.groupBy("run_id", "step_id").agg(F.count("key").alias("inputs"), F.sum(F.when(F.col("made") == "completed", 1).otherwise(0)).cast("long").alias("ready"))
    return out.withColumn("can_begin", F.col("inputs") == F.col("ready"))


def output_counts(outputs: DataFrame) -> DataFrame:
    """Records, rows, fields and components of each output by its kind."""
    kind, n = F.col("kind"), F.col("size")

    def of(*kinds: str) -> Column:
        return F.sum(F.when(kind.isin(*kinds), n).otherwise(0)).cast("long")

    return outputs.groupBy("output_id").agg(of("record_collection").alias("records"), of("data_table", "record_collection").alias("rows"), of("field_list").alias("fields"), of("structured_object").alias("components"))


def mapping_keys(tables: DataFrame, skill: str, fields: list[str]) -> DataFrame:
    """The key under which a table's column mapping is cached: skill, fields and the table's header and width."""
    signature = F.concat_ws("\u0001", F.lit(skill), F.lit(",".join(fields)), "header", F.col("width").cast("string"))
    return tables.withColumn("cache_key", F.sha2(signature, 256))


def inherited_headers(tables: DataFrame) -> DataFrame:
    """Tables with their own header, else the last one before of the same width."""
    so_far = Window.partitionBy("doc_id", "width").orderBy("table_no").rowsBetween(Window.unboundedPreceding, 0)
    return tables.select("doc_id", "table_no", "width", F.last("header", ignorenulls=True).over(so_far).alias("header"), F.col("header").isNull().alias("inherited"))


#: Marks that make a table's structure need a review.
CRITICAL_MARKS = ("complex_table_structure_review_required", "todo_complex_table_structure_review_required", "matrix_table_shape", "matrix_table")
RECORD_MARKS = ("missing_header_candidate", "ragged_rows", "many_empty_cells", "possible_continuation_without_header")


def like_data(cells: Column) -> Column:
    """Whether a first row holds data and no header: two cells or more, half of them numbers or the first one of them."""
    some = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    number = F.transform(some, lambda c: c.rlike(r"^[-+]?[0-9]+([.,:/-][0-9]+)*(\.[0-9]+)?%?$"))
    n = F.size(F.filter(number, lambda x: x))
    return (F.size(some) >= 2) & ((n >= F.greatest(F.lit(1), F.floor(F.size(some) / 2))) | F.coalesce(F.get(number, F.lit(0)), F.lit(False)))


def table_risks(tables: DataFrame, output_type: str = "record_collection") -> DataFrame:
    """What speaks for a review of each table, as marks in order, and how much: none, warning or critical.

    ``tables`` has ``doc_id, table_no, width, min_width, max_width, marks``
    (array, from reading it), ``matrix, complex`` and ``first_row``. For record
    collections a table of a width seen before whose first row holds data may
    continue one without header.
    """
    before = Window.partitionBy("doc_id", "width").orderBy("table_no")
    seen = F.row_number().over(before) > 1
    again = (F.col("width") > 0) & seen & like_data(F.col("first_row")) if output_type == "record_collection" else F.lit(False)
    none = F.array().cast("array<string>")
    more = F.concat(
        F.when(F.col("complex"), F.array(F.lit(CRITICAL_MARKS[0]), F.lit(CRITICAL_MARKS[1]))).otherwise(none),
        F.when(F.col("matrix"), F.array(F.lit("matrix_table_shape"))).otherwise(none),
        F.when(F.col("min_width") != F.col("max_width"), F.array(F.lit("ragged_rows"))).otherwise(none),
        F.when(again, F.array(F.lit("possible_continuation_without_header"))).otherwise(none),
    )
    marks = F.array_distinct(F.concat(F.filter("marks", lambda m: F.trim(m) != ""), more))
    grave = ([*RECORD_MARKS, *CRITICAL_MARKS] if output_type == "record_collection" else [*CRITICAL_MARKS]) if output_type in ("record_collection", "kv_record_table") else []
    critical = F.arrays_overlap("found", F.array(*map(F.lit, grave))) if grave else F.lit(False)
    severity = F.when(F.size("found") == 0, "none").when(critical, "critical").otherwise("warning")
    return tables.withColumn("found", marks).select("doc_id", "table_no", F.array_join(F.slice("found", 1, 12), ",").alias("marks"), severity.alias("severity"))


def resolved_pages(requests: DataFrame) -> DataFrame:
    """Pages of each request: its own page, else its range, else its references, else the pages its text names, else all; kept to those there are."""
    have = F.col("available")

    def some(pages: Column) -> Column:
        kept = F.array_intersect(F.coalesce(pages, F.array().cast("array<int>")), have)
        return F.when(F.size(kept) > 0, F.array_sort(kept))

    named = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)page\s*([0-9]{1,4})"), F.lit(1)), lambda x: x.cast("int"))
    span = F.when(F.col("start").isNotNull() & (F.col("start") <= F.col("end")), F.sequence("start", "end"))
    return requests.select("request_id", F.coalesce(some(F.when(F.col("page").isNotNull(), F.array("page"))), some(span), some(F.col("refs")), some(named), F.array_sort(have)).alias("pages"))


def matched_blocks(values: DataFrame, blocks: DataFrame, most: int = 2) -> DataFrame:
    """The best blocks for each value among those of the first page with one that holds it whole, in any case.

    A block scores the value's length up to 12, two more if it is a table. Words
    inside a value, between its first and last, are whole words of whatever
    holds it, so the longest of them is what value and block are joined by; a
    value of one or two words has to begin with a whole word of the block.
    """
    word = r"[^0-9A-Za-zÀ-ÿ]+"
    listed = F.filter(F.split(F.lower("value"), word), lambda w: w != "")
    inner = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))
    key = F.when(F.size("words") > 2, F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]).otherwise(F.get("words", F.lit(0)))
    asked = values.withColumn("words", listed).select("value_id", "value", key.alias("w"))
    wanted = asked.select("w").distinct()
    words = blocks.select("block_id", "page_no", F.explode(F.array_distinct(F.split(F.lower("text"), word))).alias("w")).join(wanted, "w", "left_semi")
    near = asked.join(words, "w").join(blocks.select("block_id", "kind", "text"), "block_id").where(F.contains(F.lower("text"), F.lower("value")))
    score = F.least(F.length("value"), F.lit(12)) + F.when(F.col("kind") == "table", 2).otherwise(0)
    place = F.row_number().over(Window.partitionBy("value_id").orderBy("page_no", F.desc("score"), "block_id"))
    first = F.min("page_no").over(Window.partitionBy("value_id"))
    best = near.select("value_id", "page_no", "block_id", score.alias("score")).withColumn("place", place).where(F.col("place") <= most).withColumn("first", first)
    return best.where("page_no = first").select("value_id", "place", "block_id", "score")


def value_map(pairs: DataFrame) -> DataFrame:
    """Distinct values of each key in the order they first occur, joined."""
    first = pairs.groupBy("group_id", "key", "value").agg(F.min("ord").alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda x: x["value"])
    return first.groupBy("group_id", "key").agg(F.array_join(listed, " | ").alias("values"), F.count("*").alias("distinct_values"))


def merged_outputs(chunks: DataFrame) -> DataFrame:
    """Chunk outputs as one list a run: ids prefixed by step, errors once, review where any chunk needs it."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("step", "output_id"))), lambda x: F.concat(x["step"].cast("string"), F.lit("-"), x["output_id"].cast("string")))
    return chunks.groupBy("run_id").agg(
        F.array_join(ids, ",").alias("outputs"),
        F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"),
        F.when(F.max((F.col("status") == "needs_review").cast("int")) == 1, "needs_review").otherwise("completed").alias("status"),
        F.min("page_no").alias("start_page"),
        F.max("page_no").alias("end_page"),
    )


def record_objects(records: DataFrame, components: DataFrame) -> DataFrame:
    """Records as objects: scalars as pairs, components as a table, in order, as JSON."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "amount"))), lambda x: F.struct(x["name"].alias("name"), x["amount"].alias("amount")))
    held = components.groupBy("record_id").agg(listed.alias("table"), F.count("*").alias("rows"))
    joined = records.join(held, "record_id")
    return joined.select(F.concat(F.lit("object:"), F.col("record_id").cast("string")).alias("id"), "rows", F.to_json(F.col("table")).alias("table_json"))


REGISTRY: dict[str, Callable[[pd.Series], pd.Series]] = {
    "word_count": lambda s: s.fillna("").str.split().str.len(),
    "checksum": lambda s: s.fillna("").map(lambda x: sum(x.encode()) % 97),
}


def controlled(rows: DataFrame, name: str, column: str) -> DataFrame:
    """``rows`` with ``result``, a registered function of a column; names not registered are refused."""
    if name not in REGISTRY:
        raise KeyError(f"{name} is not a registered function")
    found = REGISTRY[name]

    def run(values: pd.Series) -> pd.Series:
        return found(values).astype("int64")

    return rows.withColumn("result", F.pandas_udf(run, "long")(F.col(column)))
