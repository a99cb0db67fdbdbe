"""Model results and stored records of uncertain shape: parsed once as VARIANT, coerced by path, what does not fit kept beside them.

A row never stops a query: what is wrong with it is named in ``error`` or
``errors``, and what no column takes stays in ``rescued``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of results, and the summary of a sample's result without one.
KINDS = ("decision", "object", "table", "text")
NO_SUMMARY = "样例处理完成。"
PAGE_WORDS = r"第\s*(\d+)\s*页"

#: Most errors and references that an operation's result keeps.
MOST_LISTED = 20

REFS = "array<struct<page_no:int,block_id:string,block_position:string,excerpt:string>>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _is(value: Column, *types: str) -> Column:
    """Whether a VARIANT is there and of one of the types; one of JSON's null is of none."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0).isin(*types), F.lit(False))


def _at(members: Column, *names: str) -> Column:
    """The member of the first of the names that is there, even if it is null."""
    return F.coalesce(*[F.when(F.map_contains_key(members, F.lit(n)), F.struct(members[n].alias("v"))) for n in names])["v"]


def _said(value: Column) -> Column:
    """A member as trimmed text; null, false, zero and what is empty say nothing."""
    text = value.cast("string")
    nothing = ~_is(value, "STRING") & text.isin("false", "0", "[]", "{}")
    return F.when(nothing, "").otherwise(F.coalesce(stripped(text), F.lit("")))


def _first_said(members: Column, *names: str) -> Column:
    """The first of the members that says something, else nothing."""
    return F.coalesce(*[F.nullif(_said(members[n]), F.lit("")) for n in names], F.lit(""))


def _list(value: Column) -> Column:
    """A list's elements; none of what is no list."""
    return F.coalesce(F.when(_is(value, "ARRAY"), F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))


def _texts(value: Column) -> Column:
    return F.filter(F.transform(_list(value), lambda x: stripped(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))


def _members(value: Column) -> Column:
    """An object's members by name; null for what is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _without(members: Column, names: list[str]) -> Column:
    rest = F.map_filter(members, lambda k, _: ~k.isin(names))
    return F.transform_values(rest, lambda _, x: x.cast("string"))


def references(value: Column) -> Column:
    """References as a model should give them: objects of the list, with page 0 where none is told."""

    def one(x: Column) -> Column:
        text = lambda name: F.coalesce(stripped(F.try_variant_get(x, f"$.{name}", "string")), F.lit(""))
        page = F.coalesce(F.try_variant_get(x, "$.pageNo", "int"), F.lit(0))
        return F.struct(page.alias("page_no"), text("blockId").alias("block_id"), text("blockPosition").alias("block_position"), text("excerpt").alias("excerpt"))

    return F.transform(F.filter(_list(value), lambda x: _is(x, "OBJECT")), one).cast(REFS)


def coerced_references(value: Column) -> Column:
    """References of any shape: members under each of their names, pages as numbers or as words in a text; those without a page go."""

    def one(x: Column) -> Column:
        held = _members(x)
        number = F.nullif(F.coalesce(*[F.nullif(F.try_variant_get(x, f"$.{n}", "int"), F.lit(0)) for n in ("pageNo", "source_page", "page")], F.lit(0)), F.lit(0))
        words = F.concat_ws(" ", *[F.coalesce(held[n].cast("string"), F.lit("")) for n in ("source_page", "page", "text", "excerpt")])
        page = F.coalesce(number, F.nullif(F.regexp_extract(words, PAGE_WORDS, 1), F.lit("")).try_cast("int"))
        text = lambda *names: F.coalesce(*[F.nullif(held[n].cast("string"), F.lit("")) for n in names], F.lit(""))
        return F.struct(page.alias("page_no"), text("blockId", "block_id").alias("block_id"), text("blockPosition", "block_position").alias("block_position"), text("excerpt", "text", "original_text").alias("excerpt"))

    objects = F.filter(_list(value), lambda x: _is(x, "OBJECT"))
    return F.filter(F.transform(objects, one).cast(REFS), lambda r: r["page_no"].isNotNull())


def _parsed(answers: DataFrame, column: str) -> DataFrame:
    """``answers`` with its JSON column as VARIANT ``_v`` and its members ``_m``, worked out once."""
    return answers.withColumn("_v", F.try_parse_json(column)).withColumn("_m", _members(F.col("_v")))


def operation_results(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Results of operations on objects, by the contract: a summary, a kind and an output of that kind.

    ``answers`` has ``id`` and the model's answer as text. Returns ``id, summary,
    result_kind, output`` (VARIANT), ``validation_errors`` and ``refs`` (twenty
    at most), ``rescued`` (other members, as text) and ``error``, null for a
    result that holds: ``not_object, no_summary, bad_kind, no_output`` or
    ``bad_output``, the first that applies. Names may be in either case.
    """
    held = _parsed(answers, column)
    m = F.col("_m")
    output = _at(m, "output_payload", "outputPayload")
    held = held.select(
        "id", "_m", _said(m["summary"]).alias("summary"), F.lower(_said(_at(m, "result_kind", "resultKind"))).alias("result_kind"), output.alias("output"), _is(output, "STRING").alias("_text"), _is(output, "OBJECT").alias("_object"),
        (_is(F.try_variant_get(output, "$.headers", "variant"), "ARRAY") & _is(F.try_variant_get(output, "$.rows", "variant"), "ARRAY")).alias("_table"),
    )
    kind = F.col("result_kind")
    fits = F.when(kind == "text", F.col("_text")).when(kind == "table", F.col("_object") & F.col("_table")).otherwise(F.col("_object"))
    there = F.map_contains_key("_m", F.lit("output_payload")) | F.map_contains_key("_m", F.lit("outputPayload"))
    error = F.when(m.isNull(), "not_object").when(F.col("summary") == "", "no_summary").when(~kind.isin(*KINDS), "bad_kind").when(~there, "no_output").when(~fits, "bad_output")
    errors = F.slice(_texts(_at(m, "validation_errors", "validationErrors")), 1, MOST_LISTED)
    refs = F.slice(references(_at(m, "evidence_refs", "evidenceRefs")), 1, MOST_LISTED)
    known = ["summary", "result_kind", "resultKind", "output_payload", "outputPayload", "validation_errors", "validationErrors", "evidence_refs", "evidenceRefs"]
    return held.select("id", "summary", "result_kind", "output", errors.alias("validation_errors"), refs.alias("refs"), _without(m, known).alias("rescued"), error.alias("error"))


def sample_results(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Results of samples, tolerant of every shape: ``id, summary, result_kind, output`` (JSON text), ``validation_errors``.

    A kind that is not told follows from the output: a table by headers and rows,
    a text or a decision by their members, else an object. Without an output all
    members that are not known are it. A table's headers and rows are lists, if
    empty ones; a text is an object's member. Answers that are no object are
    empty objects.
    """
    held = _parsed(answers, column).withColumn("_m", F.coalesce("_m", F.create_map().cast("map<string,variant>")))
    m = F.col("_m")
    given = _at(m, "outputPayload", "output_payload")
    there = F.map_contains_key(m, F.lit("outputPayload")) | F.map_contains_key(m, F.lit("output_payload"))
    told = _first_said(m, "resultKind", "result_kind")
    held = held.select("id", "_m", given.alias("_given"), there.alias("_there"), told.alias("_told"), _members(given).alias("_o"))
    o = F.col("_o")
    table = _is(o["headers"], "ARRAY") & _is(o["rows"], "ARRAY")
    shape = F.when(table, "table").when(F.map_contains_key(o, F.lit("text")) & (F.size(o) <= 2), "text").when(F.map_contains_key(o, F.lit("decision")), "decision").otherwise("object")
    kind = F.when(F.col("_told").isin(*KINDS), F.col("_told")).when(o.isNotNull(), shape).otherwise("object")
    rest = F.map_filter(m, lambda k, _: ~k.isin("summary", "resultKind", "result_kind", "validationErrors", "validation_errors", "errors"))
    lists = [F.when(_is(o[n], "ARRAY"), o[n]).otherwise(F.parse_json(F.lit("[]"))) for n in ("headers", "rows")]
    whole = F.map_concat(F.create_map(F.lit("headers"), lists[0], F.lit("rows"), lists[1]), F.map_filter(o, lambda k, _: ~k.isin("headers", "rows")))
    of_table = F.to_json(F.when(kind == "table", F.when(o.isNotNull(), whole)))
    of_text = F.when((kind == "text") & _is(F.col("_given"), "STRING"), F.to_json(F.create_map(F.lit("text"), F.col("_given"))))
    plain = F.when(~F.col("_there"), F.to_json(rest)).otherwise(F.coalesce(F.when(F.schema_of_variant("_given") == "VOID", "{}"), F.to_json("_given"), F.lit("{}")))
    errors = F.coalesce(*[F.when(_is(m[n], "ARRAY"), _texts(m[n])) for n in ("validationErrors", "validation_errors", "errors")], F.array().cast("array<string>"))
    summary = F.coalesce(F.nullif(_said(m["summary"]), F.lit("")), F.lit(NO_SUMMARY))
    return held.select("id", summary.alias("summary"), kind.alias("result_kind"), F.coalesce(of_table, of_text, plain).alias("output"), errors.alias("validation_errors"))


def records(rows: DataFrame, lists: list[str], objects: list[str], rescued: str | None = None) -> DataFrame:
    """Stored rows with their JSON text columns typed: ``lists`` as arrays of trimmed texts, ``objects`` as maps of VARIANT.

    A list that is null, no JSON or no list is empty and named in ``errors``; an
    object that is null or empty text is an empty map without an error. With
    ``rescued``, texts that do not fit are kept in a map of that name. Columns
    that are not named are as they were.
    """
    values, wrong, kept = {}, [], []
    for name in [*lists, *objects]:
        v = F.try_parse_json(name)
        if name in lists:
            error = F.when(F.col(name).isNull(), "null").when(v.isNull(), "no_json").when(~_is(v, "ARRAY"), "no_list")
            values[name] = _texts(v)
        else:
            error = F.when(F.coalesce(name, F.lit("")) == "", None).when(v.isNull(), "no_json").when(~_is(v, "OBJECT"), "no_object")
            values[name] = F.coalesce(_members(v), F.create_map().cast("map<string,variant>"))
        wrong.append(F.when(error.isNotNull(), F.concat(F.lit(f"{name}:"), error)))
        kept.append(F.when(error.isNotNull() & F.col(name).isNotNull(), F.create_map(F.lit(name), F.col(name))).otherwise(F.create_map().cast("map<string,string>")))
    extra = {"errors": F.array_compact(F.array(*wrong))}
    if rescued:
        extra[rescued] = reduce(F.map_concat, kept)
    return rows.withColumns({**values, **extra})


def light(rows: DataFrame, payloads: list[str]) -> DataFrame:
    """Rows without their payloads, and which of those there are; the payloads' columns are not read for more than being there."""
    return rows.withColumn("has", F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), p) for p in payloads]))).drop(*payloads)


def resolved(asked: DataFrame, skills: DataFrame, executors: list[str] | None = None) -> DataFrame:
    """The record that each question for a skill means: the customer's own before the platform's, active ones only.

    ``asked`` has ``ask_id, skill_id`` and, null where it does not matter,
    ``customer_id, version``; ``skills`` has ``skill_id, customer_id`` (null for
    the platform), ``version, status, executor, place``. Of records of the same
    owner the first by ``place`` counts, whatever its version, unless a version
    is asked for. ``found`` is null where there is none. Each owner's records
    are one a version before they are joined, by an equality for the customer's
    and one for the platform's, so a skill that many ask for brings no more rows
    than it has versions.
    """
    active = skills.where(F.col("status") == "active")
    if executors is not None:
        active = active.where(F.col("customer_id").isNull() | F.col("executor").isin(executors))
    first = active.groupBy("skill_id", "customer_id", "version").agg(F.min_by(F.struct("customer_id", "version", "executor"), "place").alias("r"), F.min("place").alias("place"))
    a, s = asked.select("ask_id", "skill_id", F.col("customer_id").alias("asker"), F.col("version").alias("wanted")), first.drop("version")
    own = a.join(s.withColumnRenamed("customer_id", "asker"), ["skill_id", "asker"]).withColumn("own", F.lit(0))
    rest = a.join(s.where("customer_id is null").drop("customer_id"), "skill_id").withColumn("own", F.lit(1))
    met = own.unionByName(rest).where(F.col("wanted").isNull() | (F.col("wanted") == F.col("r.version")))
    best = met.groupBy("ask_id").agg(F.min_by("r", F.struct("own", "place")).alias("found"))
    return asked.join(best, "ask_id", "left")
