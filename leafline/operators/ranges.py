"""Which stretch of a document's pages a node of its tree stands for, by their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a page, containment, a common opening and common signs add, from where on a match counts, and how much of a text is looked at.
SAME_PAGE, CONTAINED, OPENING, SIGNS, ENOUGH = 0.08, 0.6, 0.22, 0.32, 0.22
MOST_SIGNS, OPENING_SIGNS, SHORT_SIGNS, LONG_SIGNS = 5000, 180, 800, 1600


def range_key(text: Column) -> Column:
    """Letters and digits in lower case, without split marks, the first 5,000."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|txt_split\|>?", "")
    return F.substring(F.lower(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "")), 1, MOST_SIGNS)


def signs(key: Column, most: int) -> Column:
    """Distinct signs of the beginning of a key."""
    return F.array_distinct(F.filter(F.split(F.substring(key, 1, most), ""), lambda c: c != ""))


def _keyed(df: DataFrame, prefix: str) -> DataFrame:
    """``df`` with its text as key and, worked out once a text, its length and signs."""
    held = df.withColumn(f"{prefix}key", range_key(F.col("text"))).where(F.col(f"{prefix}key") != "")
    return held.select(*[c for c in held.columns if c != "text"], F.length(f"{prefix}key").alias(f"{prefix}n"), signs(F.col(f"{prefix}key"), SHORT_SIGNS).alias(f"{prefix}short"), signs(F.col(f"{prefix}key"), LONG_SIGNS).alias(f"{prefix}long"))


def text_matches(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The range that each node's text fits best: ``doc_id, node_id, range_id, score``; of equal ones the first.

    ``nodes`` has ``doc_id, node_id, pages`` (array) and ``text``, ``ranges``
    ``doc_id, page_no, ord, range_id`` and ``text``. A node with pages meets the
    ranges on them, joined by equality; one without meets all of its document,
    which bounds how many these are. One text in the other adds .6, the shorter
    one's first 180 signs in the longer .22, the share of its signs that the
    longer has up to .32, a page .08; nodes below .22, or without text, have no
    range.
    """
    a = _keyed(nodes.select("doc_id", "node_id", "pages", "text"), "a_")
    # keys and signs are many times their texts, so what looks small on disk is not sent whole through the driver
    b = _keyed(ranges.select("doc_id", "page_no", "ord", "range_id", "text"), "b_").hint("merge")
    paged = a.withColumn("page_no", F.explode(F.array_distinct("pages"))).drop("pages").withColumn("same", F.lit(SAME_PAGE))
    loose = a.where(F.size(F.coalesce("pages", F.array().cast("array<int>"))) == 0).drop("pages").withColumn("same", F.lit(0.0))
    met = paged.join(b, ["doc_id", "page_no"]).unionByName(loose.join(b, "doc_id").select(*paged.join(b, ["doc_id", "page_no"]).columns))
    first = F.col("a_n") <= F.col("b_n")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    met = met.withColumn("shorter", pick("a_key", "b_key")).withColumn("longer", pick("b_key", "a_key")).withColumn("few", pick("a_short", "b_short")).withColumn("many", pick("b_long", "a_long"))
    common = F.size(F.array_intersect("few", "many")) / F.greatest(F.size("few"), F.lit(1)) * SIGNS
    # of two texts only the shorter can lie in the other
    score = F.col("same") + F.when(F.contains("longer", "shorter"), CONTAINED).otherwise(0.0) + F.when(F.contains("longer", F.substring("shorter", 1, OPENING_SIGNS)), OPENING).otherwise(0.0) + F.least(F.lit(SIGNS), common)
    scored = met.select("doc_id", "node_id", "range_id", "ord", score.alias("score"))
    best = F.max_by(F.struct("range_id", "score"), F.struct("score", (-F.col("ord")).alias("o"))).alias("b")
    return scored.groupBy("doc_id", "node_id").agg(best).where(F.col("b.score") >= ENOUGH).select("doc_id", "node_id", "b.range_id", F.round("b.score", 6).alias("score"))
