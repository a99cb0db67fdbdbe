"""Facts joined with the evidence, rows, runs and objects they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hydrated_refs(refs: DataFrame, blocks: DataFrame, pages: DataFrame, most: int = 200) -> DataFrame:
    """The blocks each item refers to, with an excerpt; an item none of whose blocks is there refers to its first page.

    ``refs`` has ``item_id, ord, block_id`` and ``fallback`` text, ``blocks``
    ``block_id, page_no, position, content, title``, ``pages`` ``page_no``.
    """
    text = F.coalesce(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("content", "title", "fallback")], F.lit(""))
    found = refs.join(blocks, "block_id").select("item_id", "ord", "page_no", "block_id", F.coalesce("position", F.lit("")).alias("position"), F.substring(F.trim(text), 1, most).alias("excerpt"))
    first = pages.agg(F.coalesce(F.min("page_no"), F.lit(1)).alias("page_no"))  # one row
    lost = refs.join(found.select("item_id").distinct(), "item_id", "left_anti").groupBy("item_id").agg(F.min_by("fallback", "ord").alias("fallback"))
    bare = lost.join(F.broadcast(first)).select("item_id", F.lit(0).cast("long").alias("ord"), "page_no", F.lit("").alias("block_id"), F.lit("").alias("position"), F.substring(F.trim(F.coalesce("fallback", F.lit(""))), 1, most).alias("excerpt"))
    return found.unionByName(bare)


def with_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``facts`` with the evidence of their page and fact index; of several the last by ``ord``."""
    last = evidence.where("fact_index is not null").groupBy("page_no", "fact_index").agg(F.max_by("evidence_id", "ord").alias("evidence_id"))
    return facts.join(last, ["page_no", "fact_index"], "left")


def previewed(full: DataFrame, preview: DataFrame) -> DataFrame:
    """Tables of each document that its preview shows: by page and fact index, else by page and any id, else all.

    Both have ``doc_id, page_no, fact_index, block_id, ordinal``.
    """
    by_index = full.join(preview.select("doc_id", "page_no", "fact_index").distinct(), ["doc_id", "page_no", "fact_index"], "left_semi")

    def ids(rows: DataFrame) -> DataFrame:
        return rows.withColumn("id", F.explode(F.array_distinct(F.filter(F.array(F.trim("block_id"), F.trim("ordinal")), lambda x: x.isNotNull() & (x != "")))))

    keys = ids(preview).select("doc_id", "page_no", "id").distinct()
    by_id = ids(full).join(keys, ["doc_id", "page_no", "id"], "left_semi").drop("id").distinct()
    indexed, named = (x.select("doc_id").distinct() for x in (by_index, by_id))
    second = by_id.join(indexed, "doc_id", "left_anti")
    third = full.join(indexed, "doc_id", "left_anti").join(named, "doc_id", "left_anti")
    return by_index.unionByName(second).unionByName(third)


def decided_rows(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each row with the decision for its anchor, else for its index.

    ``rows`` has ``group_id, row_index, anchor``, ``decisions`` ``group_id,
    anchor, row_index, decision``; of several for one key the first by
    ``decision_no`` counts. ``how`` is anchor, index or none.
    """
    first = F.min(F.struct("decision_no", "decision"))["decision"]
    by_anchor = decisions.where("anchor <> ''").groupBy("group_id", "anchor").agg(first.alias("a"))
    by_index = decisions.where("row_index is not null").groupBy("group_id", "row_index").agg(first.alias("b"))
    held = rows.join(by_anchor, ["group_id", "anchor"], "left").join(by_index, ["group_id", "row_index"], "left")
    how = F.when(F.col("a").isNotNull(), "anchor").when(F.col("b").isNotNull(), "index").otherwise("none")
    return held.select("group_id", "row_index", "anchor", F.coalesce("a", "b").alias("decision"), how.alias("how"))


def target_evidence(targets: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each block of a target that evidence knows: ``target_id, place, block_id, evidence_id``."""
    asked = targets.select("target_id", F.posexplode("block_ids").alias("place", "block_id"))
    return asked.join(evidence.select("block_id", "evidence_id"), "block_id").select("target_id", "place", "block_id", "evidence_id")


def chained(runs: DataFrame, upstream: DataFrame, most: int = 5) -> DataFrame:
    """Each run with the summaries of its last upstream runs, in order, at most ``most``.

    ``upstream`` has ``run_id, upstream_id, ord``; ``runs`` ``run_id, summary``.
    """
    met = upstream.join(runs.select(F.col("run_id").alias("upstream_id"), F.substring(F.coalesce("summary", F.lit("")), 1, 500).alias("summary")), "upstream_id")
    last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("ord")))
    kept = met.withColumn("r", last).where(F.col("r") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda x: x["summary"])
    return kept.groupBy("run_id").agg(F.array_join(listed, "\n").alias("context"), F.count("*").alias("steps"))


def target_index(target: Column, kind: str) -> Column:
    """The place of a table or structured object that a target's id ends with, -1 if none."""
    found = F.regexp_extract(F.trim(F.coalesce(target, F.lit(""))), rf"{kind}:[0-9]+:([0-9]+)$", 1)
    return F.when(found == "", -1).otherwise(found.cast("int"))


def target_objects(targets: DataFrame, objects: DataFrame, kind: str = "table") -> DataFrame:
    """Each target with the object of its document at the place its id names, null where there is none."""
    asked = targets.select("doc_id", "target_id", target_index(F.col("target_id"), kind).alias("place"))
    return asked.join(objects.select("doc_id", "place", "object_id"), ["doc_id", "place"], "left").select("doc_id", "target_id", "place", "object_id")


def run_outputs(runs: DataFrame, steps: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each run with its steps in order and their final outputs: ``run_id, steps, outputs``; steps without output count."""
    final = outputs.where("final").groupBy("run_id", "step_no").agg(F.array_sort(F.collect_list("output_id")).alias("o"))
    held = steps.join(final, ["run_id", "step_no"], "left")
    order = F.array_sort(F.collect_list(F.struct("step_no", "step_id", F.coalesce("o", F.array().cast("array<string>")).alias("o"))))
    listed = held.groupBy("run_id").agg(order.alias("s"))
    made = listed.select("run_id", F.array_join(F.transform("s", lambda x: x["step_id"]), ",").alias("steps"), F.array_join(F.flatten(F.transform("s", lambda x: x["o"])), ",").alias("outputs"))
    return runs.select("run_id").join(made, "run_id", "left").fillna("", ["steps", "outputs"])


def candidate_union(*sources: DataFrame) -> DataFrame:
    """Candidates of several sources as one list a query, each node of a source once: its best by score, then page, then node.

    Each has ``query_id, source, node_id, page_no, score``.
    """
    both = sources[0]
    for other in sources[1:]:
        both = both.unionByName(other)
    best = F.max(F.struct("score", (-F.col("page_no")).alias("p"))).alias("b")
    held = both.groupBy("query_id", F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("page_block")).alias("source"), "node_id").agg(best)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("b.score"), F.desc("b.p"), F.desc("node_id"), "source"))
    return held.select("query_id", place.alias("place"), "source", "node_id", (-F.col("b.p")).alias("page_no"), F.col("b.score").alias("score"))


def requested_fields(existing: DataFrame, incoming: DataFrame, key: Column) -> DataFrame:
    """Field names of each group in order, incoming ones after those there are, each alias once; names without alias go."""
    both = existing.withColumn("part", F.lit(0)).unionByName(incoming.withColumn("part", F.lit(1))).withColumn("k", key)
    first = both.where("k <> ''").groupBy("group_id", "k").agg(F.min(F.struct("part", "ord", "name")).alias("o"))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("o"))
    return first.select("group_id", place.alias("place"), F.col("o.name").alias("name"))
