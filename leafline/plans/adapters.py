"""The driver's tables seen as documents, runs, blocks and tables.

The SQL texts give the oracles the same view; they share no code with the
Spark plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.session import table

STATUS = {"purchase": "completed", "error": "failed", "view": "running", "click": "needs_review", "signup": "pending"}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of their user's task."""
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("event_type")]
    start = k % 7 + 1
    ms = F.round(F.col("value") * 1000).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        (F.col("user_id") % 200).alias("task_id"),
        F.when(k % 9 == 0, "summary").otherwise("page").alias("run_type"),
        start.alias("start_page"),
        (start + k % 3).alias("end_page"),
        F.when(k % 2 == 0, "extract").otherwise("post_process").alias("run_purpose"),
        F.concat(F.lit("t"), (k % 4).cast("string")).alias("template_id"),
        F.concat(F.lit("prompt"), (k % 5).cast("string")).alias("prompt_name"),
        status.alias("status"),
        F.col("ts").alias("updated_at"),
        ms.alias("total_ms"),
        (ms + 7).alias("http_ms"),
        F.when(k % 5 != 0, k * 3).alias("prompt_tokens"),
        F.when(k % 6 != 0, k).alias("completion_tokens"),
        F.concat(F.lit("model-"), (k % 3).cast("string")).alias("model"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("text "), F.col("event_id").cast("string"))).alias("output_text"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error_message"),
    )


RUNS = """runs AS (
  SELECT event_id AS run_id, user_id % 200 AS task_id, CASE WHEN k % 9 = 0 THEN 'summary' ELSE 'page' END AS run_type,
    k % 7 + 1 AS start_page, k % 7 + 1 + k % 3 AS end_page,
    CASE WHEN k % 2 = 0 THEN 'extract' ELSE 'post_process' END AS run_purpose, 't' || (k % 4) AS template_id, 'prompt' || (k % 5) AS prompt_name,
    CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'click' THEN 'needs_review' WHEN 'signup' THEN 'pending' END AS status,
    ts AS updated_at, CAST(round(value * 1000) AS BIGINT) AS total_ms, CAST(round(value * 1000) AS BIGINT) + 7 AS http_ms,
    CASE WHEN k % 5 <> 0 THEN k * 3 END AS prompt_tokens, CASE WHEN k % 6 <> 0 THEN k END AS completion_tokens, 'model-' || (k % 3) AS model,
    CASE WHEN event_type <> 'error' THEN 'text ' || event_id END AS output_text, CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error_message
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def task_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine pages for every task that has runs."""
    tasks = runs(spark, sf_dir).select("task_id").distinct()
    return tasks.withColumn("page_no", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))))


TASK_PAGES = "task_pages AS (SELECT task_id, page_no FROM (SELECT DISTINCT task_id FROM runs), (SELECT CAST(unnest(range(1, 10)) AS BIGINT) AS page_no))"

#: Lines of an order in a fixed order; equal lines are told apart by none of these, and need not be.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as table rows: ``table_id``, ``row_index`` from 0, and cells as text."""
    from pyspark.sql import Window

    line = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)) - 1
    return line.select(
        F.col("l_orderkey").alias("table_id"),
        place.cast("long").alias("row_index"),
        F.col("l_linenumber").cast("string").alias("line"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part"),
        F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").cast("date").cast("string").alias("shipped"),
    )


LINES = """lines AS (
  SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row_index,
    CAST(l_linenumber AS VARCHAR) AS line, 'P' || l_partkey AS part, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS quantity,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price, l_returnflag AS flag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped
  FROM lineitem
)"""

HEADERS = ("Line", "Part", "Quantity", "Price", "Flag", "Shipped")
CELLS = ("line", "part", "quantity", "price", "flag", "shipped")


def line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One HTML table an order: ``table_id, html``."""
    rows = lines(spark, sf_dir)
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in HEADERS) + "</tr>"
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.col(c), F.lit("</td>")) for c in CELLS], F.lit("</tr>"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("row_index", row.alias("html")))), lambda x: x["html"])
    made = rows.groupBy("table_id").agg(listed.alias("rows"))
    return made.select("table_id", F.concat(F.lit("<table>" + head), F.array_join("rows", ""), F.lit("</table>")).alias("html"))


def span_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As line_tables, with a title over all columns and one cell for each run of equal flags."""
    from pyspark.sql import Window

    rows = lines(spark, sf_dir)
    by_row = Window.partitionBy("table_id").orderBy("row_index")
    starts = F.when(F.lag("flag").over(by_row) == F.col("flag"), 0).otherwise(1)
    runs_ = rows.withColumn("starts", starts).withColumn("run", F.sum("starts").over(by_row))
    size = F.count("*").over(Window.partitionBy("table_id", "run"))
    runs_ = runs_.withColumn("size", size)
    lead = F.when(F.col("starts") == 1, F.concat(F.lit("<td rowspan=\""), F.col("size").cast("string"), F.lit("\">"), F.col("flag"), F.lit("</td>"))).otherwise("")
    row = F.concat(F.lit("<tr>"), lead, *[F.concat(F.lit("<td>"), F.col(c), F.lit("</td>")) for c in ("line", "part", "price")], F.lit("</tr>"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("row_index", row.alias("html")))), lambda x: x["html"])
    made = runs_.groupBy("table_id").agg(listed.alias("rows"))
    head = F.concat(F.lit("<table><tr><th colspan=\"4\">Order "), F.col("table_id").cast("string"), F.lit("</th></tr><tr><th>Flag</th><th>Line</th><th>Part</th><th>Price</th></tr>"))
    return made.select("table_id", F.concat(head, F.array_join("rows", ""), F.lit("</table>")).alias("html"))
