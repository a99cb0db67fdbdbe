"""Conversations rendered once from each participant's side.

A conversation gives one dialogue a participant: that speaker's messages become
the assistant's and are trained on, all others become named users' and are not,
and system messages stay what they are. A dialogue is a run of segments with
their places in the rendered text, so a conversation of any length is never
gathered into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm.runtime import Tables

END = "<|im_end|>\n"


def perspectives(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: str = "system",
) -> DataFrame:
    """One row per conversation, participant and message.

    Returns ``conv_id, perspective, position`` (from 0), ``speaker, role``
    (assistant, user or system), ``name`` (of users), ``train`` (the loss mask),
    ``segment`` (as rendered), and ``begin, end``, its code points in the
    dialogue, end exclusive. The trained part of an assistant's segment is its
    content and end mark, from ``train_from``.

    Messages go by turn, null turns last, then by speaker and text; repeated
    rows are messages of their own. A null speaker is ``unknown``, a null text
    empty. A conversation in which only the system speaks has no participant
    and gives no rows; rows with a null conversation form one of their own.
    Extra columns are ignored; an empty table gives an empty result.
    """
    given = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # all messages in order, so a conversation of any size, whatever its turns, lies in as many tasks as it fills
    order = ["conv_id", F.asc_nulls_last("turn"), "speaker", "content", "tie"]
    placed = given.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = Tables(messages.sparkSession).put(placed.select("conv_id", "speaker", "content", "at", F.shiftright("at", 33).cast("int").alias("chunk"), F.length("content").alias("n")))
    lengths = placed.select("conv_id", "chunk", "at", "speaker", "n")
    counts = lengths.groupBy("conv_id", "chunk").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    people = lengths.where(F.col("speaker") != system).select(F.col("conv_id").alias("p"), F.col("speaker").alias("perspective")).distinct()
    met = lengths.join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).withColumn("position", F.col("at") + F.col("shift"))
    role = F.when(F.col("speaker") == system, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    turned = met.join(people, F.col("conv_id").eqNullSafe(F.col("p"))).withColumn("role", role)
    turned = turned.withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    turned = turned.withColumn("head", F.length(_head()).cast("long")).withColumn("size", F.col("head") + F.col("n") + len(END))
    sums = turned.groupBy("conv_id", "perspective", "chunk").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c2"), F.col("perspective").alias("p2"), F.col("chunk").alias("k2"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("ahead"))
    so_far = Window.partitionBy("conv_id", "perspective", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = turned.withColumn("so_far", F.sum("size").over(so_far))
    out = out.join(sums, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("perspective") == F.col("p2")) & (F.col("chunk") == F.col("k2")))
    out = out.select("at", "perspective", "position", "role", "name", "head", (F.col("ahead") + F.col("so_far")).alias("end"), "size")
    out = out.join(placed.select("at", "conv_id", "speaker", "content").hint("merge"), "at")
    begin, train = F.col("end") - F.col("size"), F.col("role") == "assistant"
    return out.select(
        "conv_id", "perspective", F.col("position").cast("long").alias("position"), "speaker", "role", "name", train.alias("train"), F.concat(_head(), "content", F.lit(END)).alias("segment"),
        begin.cast("long").alias("begin"), F.col("end").cast("long").alias("end"), F.when(train, begin + F.col("head")).cast("long").alias("train_from"),
    )


def _head() -> Column:
    return F.concat(F.lit("<|im_start|>"), "role", F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))


ORACLE = """
WITH given AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, speaker, content) - 1 AS position FROM given
), people AS (
  SELECT DISTINCT conv_id AS p, speaker AS perspective FROM given WHERE speaker <> 'system'
), turned AS (
  SELECT conv_id, perspective, position, speaker, content,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM placed JOIN people ON conv_id IS NOT DISTINCT FROM p
), headed AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM turned
), rendered AS (
  SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM headed
), ended AS (
  SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position ROWS UNBOUNDED PRECEDING) AS e FROM rendered
)
SELECT conv_id, perspective, position::BIGINT AS position, speaker, role, name, role = 'assistant' AS train, segment,
  (e - length(segment))::BIGINT AS "begin", e::BIGINT AS "end",
  CASE WHEN role = 'assistant' THEN (e - length(segment) + length(head))::BIGINT END AS train_from
FROM ended
"""
