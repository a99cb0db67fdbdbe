"""Evidence chosen for many queries at once: items of blocks, an inverted index, selections by kind of output and their report.

A query is a contract over one document: ``query_id, doc_id, output_type,
fields, terms, pages, selected`` (ids) and ``source_text``. All selections are
joins of contracts with their document's items, ranked in groups.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions.text import bound, id_matches, match_key
from leafline.lineage import cut
from leafline.operators.evidence import FALLBACK, FIELD_LIKE, MOST_SELECTED, PAGE, SELECTED, TERM_BASE, TERM_COUNT, TERM_EACH, TERM_MOST

#: Signs of an excerpt and of a title, rows shown, and what context around chosen items adds.
EXCERPT, TITLE, ROWS_SHOWN, RECORD_SHAPE, CONTEXT_BASE, CONTEXT_LIKE, CONTEXT_MIXED, CONTEXT_NEAR, MOST_CONTEXT, REPORT = 640, 420, 8, 35, 18, 16, 8, 12, 12, 16_000
FIELD_SHAPES = ("kv_or_field_table", "mixed_table")


def compact(text: Column, most: int) -> Column:
    """A text without blanks around it, cut to ``most`` signs with three dots behind."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.substring(plain, 1, most), F.lit("...")))


def index_items(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """An evidence item for each block.

    ``blocks`` has ``doc_id, page_no, block_index, kind, title, text, rows``
    (texts of a table's rows, null where it is none), ``shape_type`` and
    ``warnings``; ``refs``, joined by the first three, ``ref_id, block_id,
    source_ordinal, nearby_title, excerpt, uncertainties``. An item is named by
    its reference, else by page and block. Its excerpt joins both texts and the
    first four rows; ``key`` is what terms are looked for in.
    """
    on = ["doc_id", "page_no", "block_index"]
    held = blocks.join(refs, on, "left")
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    rows = F.filter(F.transform(F.coalesce("rows", F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    table = F.col("rows").isNotNull()
    item = held.select(
        "doc_id", "page_no", "block_index",
        F.coalesce(filled(F.col("ref_id")), filled(F.col("source_ordinal")), F.format_string("ev2:p%d:b%d", "page_no", "block_index")).alias("id"),
        F.when(table, "table").otherwise(F.coalesce(filled(F.col("kind")), F.lit("text"))).alias("source_type"),
        F.coalesce(filled(F.col("block_id")), F.lit("")).alias("block_id"), F.coalesce(filled(F.col("source_ordinal")), filled(F.col("ref_id")), F.lit("")).alias("source_ordinal"),
        compact(F.col("title"), TITLE).alias("title"), compact(F.col("nearby_title"), TITLE).alias("nearby_title"),
        compact(F.array_join(F.concat(F.array_compact(F.array(filled(F.col("text")), filled(F.col("excerpt")))), F.slice(rows, 1, 4)), " "), EXCERPT).alias("excerpt"),
        F.when(table, F.col("shape_type")).alias("shape_type"), F.slice(rows, 1, ROWS_SHOWN).alias("shown"),
        F.array_distinct(F.filter(F.concat(F.coalesce("uncertainties", F.array().cast("array<string>")), F.coalesce("warnings", F.array().cast("array<string>"))), lambda x: F.trim(x) != "")).alias("uncertainties"),
    )
    key = F.concat(match_key(F.concat_ws(" ", "title", "nearby_title", "excerpt")), match_key(F.array_join("shown", " ")))
    return item.withColumn("key", key).drop("shown")


def inverted(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An index of items by word: its postings ``w, id, page_no``, and ``w, df``, in how many items a word is.

    ``items`` has ``id, page_no`` and ``words``, an array.
    """
    postings = items.select("id", "page_no", F.explode_outer(bound(F.col("words"), F.array_distinct)).alias("w")).where("w is not null")
    return postings, postings.groupBy("w").agg(F.count("*").alias("df"))


def best_items(items: DataFrame, queries: DataFrame, most: int = 2, words_bytes: int = 16 << 20) -> DataFrame:
    """The items that hold most of each query's words: ``query_id, rank, id, hits``; of equal ones those of the earlier page, then the smaller id.

    ``queries`` has ``query_id`` and ``words``. A query's words are taken from
    the rarest on, in rounds of 1, 2, 3, 4, 6, 9 words and so on. An item with none of the words
    so far has at most as many as are left, so a query is done as soon as its
    ``most``-th best has more; the commonest words' postings are then never
    read. Candidates that can still be among the best are counted whole, by the
    rest of the query's words. Only postings of words that are asked for are
    kept. The queries' words go to all tasks if together they hold at most
    ``words_bytes``, so that a round reads postings where they lie, and are
    joined by shuffles beyond that.
    """
    named = cut(queries.select("query_id", F.explode(F.array_distinct("words")).alias("w")))
    held = (named.agg(F.sum(F.octet_length("w") + 32)).first()[0] or 0) <= words_bytes

    def near(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if held else df

    # an inner explode brings a filter on its array, for which the texts would be cut into words once more
    postings = items.select("id", "page_no", F.explode_outer(bound(F.col("words"), F.array_distinct)).alias("w"))
    # kept by columns, as each round reads all of them
    postings = postings.join(near(named.select("w").distinct()), "w", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    frequencies = cut(postings.groupBy("w").agg(F.count("*").alias("df")))
    asked = named.join(near(frequencies), "w")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "w"))
    asked = cut(asked.withColumn("turn", turn).withColumn("n", F.count("*").over(Window.partitionBy("query_id"))))
    waiting, counts, done, read, size = asked, None, [], 0, 1
    while waiting.take(1):
        new = postings.join(near(waiting.where((F.col("turn") <= size) & (F.col("turn") > read))), "w").select("query_id", "id", "page_no", F.lit(1).alias("c"))
        counts = new if counts is None else counts.unionByName(new)
        counts = cut(counts.groupBy("query_id", "id", "page_no").agg(F.sum("c").alias("c")))
        # what the most-th best has, from how many items have how much
        so_far = F.sum("items").over(Window.partitionBy("query_id").orderBy(F.desc("c")))
        least = counts.groupBy("query_id", "c").agg(F.count("*").alias("items")).withColumn("so_far", so_far).where(F.col("so_far") >= most).groupBy("query_id").agg(F.max("c").alias("least"))
        state = waiting.groupBy("query_id").agg(F.max("n").alias("n")).join(near(least), "query_id", "left")
        state = state.withColumn("left", F.greatest(F.col("n") - size, F.lit(0)))
        over = cut(state.where((F.col("left") == 0) | (F.coalesce("least", F.lit(0)) > F.col("left"))))
        # what cannot reach the best any more goes
        done.append(counts.join(near(over.select("query_id", "left", F.coalesce("least", F.lit(0)).alias("least"))), "query_id").where(F.col("c") + F.col("left") >= F.col("least")).select("query_id", "id", "page_no", "c", F.lit(size).alias("read")))
        waiting = cut(waiting.join(near(over), "query_id", "left_anti"))
        counts = counts.join(near(over), "query_id", "left_anti")
        read, size = size, size + max(1, size // 2)
    if not done:
        postings.unpersist()
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(dict(items.dtypes)["id"]).alias("id"), F.lit(0).cast("long").alias("hits")).where(F.lit(False))
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    found = cut(found)
    # what the rest of a query's words adds, asked of the items that can be among its best only
    rest = found.select("query_id", F.col("read")).distinct().join(asked, "query_id").where(F.col("turn") > F.col("read")).select("query_id", "w")
    ids = cut(found.join(near(rest.select("query_id").distinct()), "query_id", "left_semi").select("id").distinct())
    some = postings.join(F.broadcast(ids) if 64 * ids.count() <= words_bytes else ids, "id", "left_semi")
    more = some.select("id", "w").join(near(rest), "w").join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id", "id").agg(F.count("*").alias("more"))
    counted = found.join(more, ["query_id", "id"], "left").select("query_id", "id", "page_no", (F.col("c") + F.coalesce("more", F.lit(0))).cast("long").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "page_no", "id"))
    best = cut(counted.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "id", "hits"))
    postings.unpersist()
    return best


def label_terms(label: Column) -> Column:
    """A label as a whole and its words, as keys of two signs or more; one that comes twice counts twice."""
    found = F.concat(F.array(label), F.regexp_extract_all(label, F.lit(r"([A-Za-z0-9_\-.]{2,}|[一-鿿]{2,})"), F.lit(1)))
    return F.filter(F.transform(found, match_key), lambda x: F.length(x) >= 2)


def _scored(met: DataFrame, terms: Column, fields: bool, fallback: bool) -> DataFrame:
    """Pairs of contract and item with ``score`` and whether its own text or shape speaks for it (``strong``), or its selection (``chosen``)."""
    some = F.size("selected") > 0
    chosen = F.exists("selected", lambda x: id_matches(F.col("block_id"), x) | id_matches(F.col("source_ordinal"), x) | id_matches(F.col("id"), x))
    paged = (F.size("pages") > 0) & F.array_contains("pages", F.col("page_no"))
    hits = F.size(F.filter(terms, lambda t: F.contains(F.col("key"), t)))
    like = F.coalesce(F.col("shape_type").isin(*FIELD_SHAPES), F.lit(False)) if fields else F.lit(False)
    held = met.withColumn("chosen", some & chosen).withColumn("hits", hits).withColumn("like", like)
    base = F.when(paged, PAGE).otherwise(0) + F.when(F.col("chosen"), SELECTED).otherwise(0) + F.when(F.col("like"), FIELD_LIKE).otherwise(0)
    base = base + F.when(F.col("hits") > 0, F.least(F.lit(TERM_MOST), TERM_BASE + TERM_EACH * F.least("hits", F.lit(TERM_COUNT)))).otherwise(0)
    if fallback:
        base = F.when((base == 0) & ((F.size("pages") == 0) | paged), FALLBACK).otherwise(base)
    total = F.greatest(F.lit(0), base - F.least(F.lit(18), 3 * F.size("uncertainties")))
    inside = ~some | F.col("chosen")
    return held.withColumn("score", F.when(inside, total).otherwise(0).cast("int")).withColumn("strong", inside & ((F.col("hits") > 0) | F.col("like")))


def _ranked(scored: DataFrame, keys: list[str], most: Column | int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "page_no", "id"))
    return scored.withColumn("place", place).where(F.col("place") <= most)


#: Columns of a selection.
CHOSEN = ("query_id", "id", "page_no", "block_index", "score", "reason", "target")


def _chosen(df: DataFrame, reason: str, target: Column | None = None) -> DataFrame:
    return df.withColumn("reason", F.lit(reason)).withColumn("target", F.lit("") if target is None else target).select(*CHOSEN)


def field_context(text: Column, source: Column, shape: Column) -> Column:
    """Whether an item looks like the surroundings of fields: tables by their shape, texts if short, or with a colon and up to 520 signs."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
    short = (F.length(text) <= 520) & (text != "") & (F.contains(text, F.lit(":")) | F.contains(text, F.lit("：")) | (words.between(1, 12) & (F.length(text) <= 180)))
    return F.when(source == "table", F.coalesce(shape.isin(*FIELD_SHAPES), F.lit(False))).otherwise(short)


def field_list_selection(contracts: DataFrame, items: DataFrame, most: int = MOST_SELECTED, unnamed: bool = True) -> DataFrame:
    """Evidence for lists of fields.

    The two best strong items of each field; without any, the best of the scope.
    A contract that names no field has the two best items of its terms, or, if
    not ``unnamed``, the best of the scope as well.
    Where less than half of the fields (two at least) are covered, neighbours on
    the pages of what was chosen that look like fields fill up, twelve at most.
    An item that several fields chose counts for the last of them.
    """
    met = contracts.join(items, "doc_id")
    own = F.filter(F.transform("fields", lambda x: F.trim(x)), lambda x: x != "")
    named = F.transform(own, lambda x, i: F.struct(i.alias("i"), x.alias("field")))
    none = F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("field"))) if unnamed else F.array().cast("array<struct<i:int,field:string>>")
    asked = contracts.withColumn("n_fields", F.size(own)).select("*", F.explode(F.when(F.size(own) > 0, named).otherwise(none)).alias("f"))
    asked = asked.withColumn("wanted", label_terms(F.col("f.field"))).withColumn("wanted", F.when(F.size("wanted") > 0, F.col("wanted")).otherwise(F.col("terms")))
    by_field = _scored(asked.join(items, "doc_id"), F.col("wanted"), True, False).where((F.col("score") > 0) & ((F.col("f.field") == "") | F.col("strong")))
    two = _ranked(by_field, ["query_id", F.col("f.i")], 2)
    last = two.groupBy("query_id", "id").agg(F.max_by(F.struct("page_no", "block_index", "score", F.col("f.field").alias("target")), F.col("f.i")).alias("x"))
    direct = last.select("query_id", "id", "x.page_no", "x.block_index", "x.score", F.lit("field").alias("reason"), "x.target")
    loose = _scored(met.join(direct.select("query_id").distinct(), "query_id", "left_anti"), F.col("terms"), True, True).where("score > 0")
    first = direct.unionByName(_chosen(_ranked(loose, ["query_id"], max(3, min(8, most))), "fallback"))

    known = first.groupBy("query_id").agg(F.count("*").alias("chosen_n"), F.array_distinct(F.filter(F.collect_list("target"), lambda x: x != "")).alias("targets"), F.collect_list(F.struct("page_no", "block_index")).alias("anchors"), F.collect_set("id").alias("ids"))
    counted = contracts.join(known, "query_id").withColumn("n_fields", F.size(own))
    short = counted.where((F.col("n_fields") > 0) & (F.size("targets") < F.least(F.col("n_fields"), F.greatest(F.lit(2), F.floor((F.col("n_fields") + 1) / 2)))) & (F.col("chosen_n") < most))
    around = short.join(items, "doc_id").where(~F.array_contains("ids", F.col("id")))
    on_pages = F.array_distinct(F.filter(F.transform("anchors", lambda x: x["page_no"]), lambda x: x != 0))
    on_pages = F.when(F.size(on_pages) > 0, on_pages).otherwise(F.col("pages"))
    near = F.filter("anchors", lambda x: (x["page_no"] == F.col("page_no")) & (x["page_no"] > 0) & (x["block_index"] >= 0) & (F.col("block_index") >= 0))
    apart = F.array_min(F.transform(near, lambda x: F.abs(F.col("block_index") - x["block_index"])))
    text = compact(F.concat_ws(" ", "title", "nearby_title", "excerpt"), 720)
    around = _scored(around.withColumn("apart", apart).withColumn("looks", field_context(text, F.col("source_type"), F.col("shape_type"))).withColumn("on", (F.size(on_pages) == 0) | F.array_contains(on_pages, F.col("page_no"))), F.array().cast("array<string>"), True, False)
    fits = F.col("on") & ((F.coalesce("apart", F.lit(0)) <= CONTEXT_NEAR) | F.col("chosen")) & (F.col("looks") | F.col("apart").isNotNull() | F.col("chosen"))
    mixed = (F.col("source_type") == "table") & (F.coalesce("shape_type", F.lit("")) == "mixed_table")
    worth = CONTEXT_BASE + F.when(F.col("looks"), CONTEXT_LIKE).otherwise(0) + F.coalesce(F.greatest(F.lit(0), CONTEXT_NEAR - F.col("apart")), F.lit(0)) - F.when(mixed, CONTEXT_MIXED).otherwise(0)
    added = around.where(fits).withColumn("score", (1 + F.greatest(F.lit(1), worth)).cast("int"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_no", "block_index", "id"))
    added = added.withColumn("place", place).where(F.col("place") <= F.least(F.lit(MOST_CONTEXT), most - F.col("chosen_n")))
    return first.unionByName(_chosen(added, "context", F.lit("__context__")))


def record_selection(contracts: DataFrame, items: DataFrame, most: int = MOST_SELECTED) -> DataFrame:
    """Evidence for collections of records: the selected source text if there is one, else the best of the selected items that say something, else the best tables, those shaped like records first."""
    text = F.trim(F.coalesce("source_text", F.lit(""))) != ""
    page = F.coalesce(F.array_min("pages"), F.lit(0))
    source = contracts.where(text).select("query_id", F.lit("runtime-contract-selected-source").alias("id"), page.alias("page_no"), F.lit(-1).alias("block_index"), F.lit(100).alias("score"), F.lit("source").alias("reason"), F.lit("").alias("target"))
    met = contracts.where(~text).join(items, "doc_id")
    scoped = _scored(met.where(F.size("selected") > 0), F.col("terms"), False, False).where((F.col("score") > 0) & (F.col("chosen") | (F.col("hits") > 0)))
    scoped = _chosen(_ranked(scoped, ["query_id"], most), "scope")
    rest = met.join(scoped.select("query_id").distinct(), "query_id", "left_anti").where("source_type = 'table'")
    tables = _scored(rest, F.col("terms"), False, True)
    tables = tables.withColumn("score", F.col("score") + F.when(F.col("shape_type") == "record_table", RECORD_SHAPE).otherwise(0)).where("score > 0")
    return source.unionByName(scoped).unionByName(_chosen(_ranked(tables, ["query_id"], most), "table"))


def selections(contracts: DataFrame, items: DataFrame, most: int = MOST_SELECTED, unnamed: bool = True) -> DataFrame:
    """Evidence of each contract by its kind of output: ``query_id, rank, id, page_no, block_index, score, reason, target``, ``most`` at most; ``unnamed`` as in ``field_list_selection``."""
    kind = F.coalesce("output_type", F.lit(""))
    lists, records, other = contracts.where(kind == "field_list"), contracts.where(kind == "record_collection"), contracts.where(~kind.isin("field_list", "record_collection"))
    generic = _scored(other.join(items, "doc_id"), F.col("terms"), False, True).where("score > 0")
    found = field_list_selection(lists, items, most, unnamed).unionByName(record_selection(records, items, most)).unionByName(_chosen(_ranked(generic, ["query_id"], most), "generic"))
    return _ranked(found, ["query_id"], most).select("query_id", F.col("place").alias("rank"), "id", "page_no", "block_index", "score", "reason", "target")


def report(contracts: DataFrame, chosen: DataFrame, items: DataFrame, most: int = REPORT) -> DataFrame:
    """The report of each contract's selection as text, cut to ``most`` signs with a line that says so: ``query_id, report``.

    Sections' lengths are summed in order first, so only what still fits is
    joined, and the last of it is cut to what is left.
    """
    met = chosen.join(contracts.select("query_id", "doc_id"), "query_id").join(items.select("doc_id", "id", "source_type", "title", "nearby_title", "excerpt", "shape_type", "uncertainties"), ["doc_id", "id"], "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("nearby_title", F.lit("")))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), "id", F.lit(" page="), F.col("page_no").cast("string"), F.lit(" source="), F.coalesce("source_type", F.lit("text"))),
        F.when(F.col("target") != "", F.concat(F.lit("targetFields: "), "target")),
        F.concat(F.lit("reasons: "), "reason"),
        F.when(title.isNotNull(), F.concat(F.lit("title: "), F.substring(title, 1, 240))),
        F.when(F.col("source_type") == "table", F.concat(F.lit("table: shape="), F.coalesce("shape_type", F.lit("table")))),
        F.when(F.coalesce("excerpt", F.lit("")) != "", F.concat(F.lit("excerpt: "), F.substring("excerpt", 1, 720))),
        F.when(F.size("uncertainties") > 0, F.concat(F.lit("uncertainties: "), F.array_join(F.slice("uncertainties", 1, 8), ", "))),
    )
    head = contracts.withColumn("own", F.filter(F.transform("fields", lambda x: F.trim(x)), lambda x: x != ""))
    head = head.select("query_id", F.concat_ws("\n", F.lit("# Evidence V2 Shadow Render"), F.concat(F.lit("outputType: "), F.coalesce(F.nullif(F.trim("output_type"), F.lit("")), F.lit("custom"))), F.when(F.size("own") > 0, F.concat(F.lit("fields: "), F.array_join(F.slice("own", 1, 40), ", ")))).alias("section"), F.lit(0).alias("rank"))
    sections = head.unionByName(met.select("query_id", F.concat(F.lit("\n\n"), lines).alias("section"), "rank"))
    before = F.coalesce(F.sum(F.length("section")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = sections.withColumn("left", F.lit(most) - before).where("left >= 0")
    fit = fit.select("query_id", "rank", F.substring("section", F.lit(1), F.greatest("left", F.lit(0)).cast("int")).alias("part"), (F.length("section") > F.col("left")).alias("cut"))
    joined = fit.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("parts"), F.max("cut").alias("cut"))
    text = F.array_join(F.transform("parts", lambda x: x["part"]), "")
    return joined.select("query_id", F.when(F.col("cut"), F.concat(text, F.lit("\n[truncated]"))).otherwise(text).alias("report"))
