"""Queries over runs, tasks and page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.operators import runs as R
from leafline.plans.adapters import RUNS, TASK_PAGES, runs, task_pages
from leafline.registry import register
from leafline.session import table


def _latest_sql(keys: tuple[str, ...], where: str = "TRUE") -> str:
    k = ", ".join(keys)
    return f"WITH {RUNS} SELECT {k}, run_id, status FROM runs WHERE {where} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY updated_at DESC, run_id DESC) = 1"


@register("runs_latest_effective", _latest_sql(R.REPOSITORY_KEY))
def runs_latest_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_effective(runs(spark, sf_dir))


@register("runs_latest_by_builder_key", _latest_sql(R.BUILDER_KEY))
def runs_latest_by_builder_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_effective(runs(spark, sf_dir), R.BUILDER_KEY)


@register("runs_latest_results", _latest_sql(R.RESULT_KEY, "status IN ('completed', 'needs_review')"))
def runs_latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_results(runs(spark, sf_dir))


@register("runs_latest_object_operations", _latest_sql(("task_id", "start_page", "template_id"), "run_purpose = 'post_process' AND status IN ('completed', 'needs_review')"))
def runs_latest_object_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_object_operations(runs(spark, sf_dir))


STATUS_SQL = "CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'needs_review') THEN 'needs_review' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'pending' END"


#: A run counts towards a status while no newer one has its scope.
EFFECTIVE = "eff AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY task_id, run_type, start_page, end_page, run_purpose, template_id, prompt_name ORDER BY updated_at DESC, run_id DESC) = 1)"


@register("runs_status_rollup", f"WITH {RUNS}, {EFFECTIVE}, n AS (SELECT task_id, run_type, count(*) AS run_count FROM runs GROUP BY ALL) SELECT task_id, run_type, {STATUS_SQL} AS status, any_value(run_count) AS run_count FROM eff JOIN n USING (task_id, run_type) GROUP BY ALL")
def runs_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.status_rollup(runs(spark, sf_dir), ("task_id", "run_type"))


@register(
    "trace_rollup",
    f"""WITH {RUNS} SELECT task_id, count(*) AS call_count, CAST(sum(CASE WHEN coalesce(nullif(total_ms, 0), http_ms, 0) >= 30000 THEN 1 ELSE 0 END) AS BIGINT) AS slow_count,
      CAST(sum(coalesce(total_ms, 0)) AS BIGINT) AS total_ms, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
      arg_max(model, row(updated_at, run_id)) AS latest_model, arg_max(status, row(updated_at, run_id)) AS latest_status FROM runs GROUP BY task_id""",
)
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trace_rollup(runs(spark, sf_dir), ("task_id",))


@register(
    "runs_task_refresh",
    f"""WITH {RUNS}, {EFFECTIVE}, e AS (SELECT task_id, {STATUS_SQL} AS status FROM eff GROUP BY 1), s AS (SELECT task_id, count(*) AS run_count, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS updated_at,
      arg_max(output_text, row(updated_at, run_id)) FILTER (run_type = 'summary' AND length(output_text) > 0) AS a,
      arg_max(output_text, row(updated_at, run_id)) FILTER (run_type <> 'summary' AND length(output_text) > 0) AS b,
      arg_max(error_message, row(updated_at, run_id)) FILTER (length(error_message) > 0) AS c FROM runs GROUP BY task_id)
    SELECT task_id, run_count, status, updated_at, substr(coalesce(a, b, c, ''), 1, 180) AS summary FROM s JOIN e USING (task_id)""",
)
def runs_task_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.refresh_tasks(runs(spark, sf_dir)).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@register(
    "task_runtime_rollup",
    f"""WITH {RUNS}, eff AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY {", ".join(R.BUILDER_KEY)} ORDER BY updated_at DESC, run_id DESC) = 1),
    last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC, run_id DESC) = 1),
    p AS (SELECT task_id, {STATUS_SQL} AS page_status FROM eff WHERE run_type <> 'summary' GROUP BY 1),
    s AS (SELECT task_id, {STATUS_SQL} AS summary_status FROM eff WHERE run_type = 'summary' GROUP BY 1),
    n AS (SELECT task_id, count(*) FILTER (run_type <> 'summary' AND status = 'failed') AS failed_pages, count(*) FILTER (run_type <> 'summary' AND status = 'completed') AS completed_pages FROM eff GROUP BY 1)
    SELECT task_id, run_id, prompt_name || ' ' || CASE WHEN start_page = end_page THEN CAST(start_page AS VARCHAR) ELSE start_page || '-' || end_page END AS label,
      coalesce(page_status, 'pending') AS page_status, coalesce(summary_status, 'pending') AS summary_status, failed_pages, completed_pages
    FROM last JOIN n USING (task_id) LEFT JOIN p USING (task_id) LEFT JOIN s USING (task_id)""",
)
def task_runtime_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runtime_rollup(runs(spark, sf_dir))


@register(
    "config_page_range_join",
    f"""WITH {RUNS}, {TASK_PAGES}, c AS (SELECT *, run_id AS config_id FROM runs WHERE run_purpose = 'extract')
    SELECT p.task_id, p.page_no, config_id, prompt_name, start_page, end_page FROM task_pages p LEFT JOIN c ON p.task_id = c.task_id AND page_no BETWEEN start_page AND end_page
    QUALIFY row_number() OVER (PARTITION BY p.task_id, p.page_no ORDER BY updated_at DESC, config_id DESC) = 1""",
)
def config_page_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = runs(spark, sf_dir).where("run_purpose = 'extract'").withColumnRenamed("run_id", "config_id")
    return R.configs_on_pages(task_pages(spark, sf_dir), configs)


@register(
    "page_latest_run_asof",
    f"""WITH {RUNS}, {TASK_PAGES}, c AS (SELECT * FROM runs WHERE status IN ('completed', 'needs_review'))
    SELECT p.task_id, p.page_no, run_id, run_type FROM task_pages p LEFT JOIN c ON p.task_id = c.task_id AND page_no BETWEEN start_page AND end_page
    QUALIFY row_number() OVER (PARTITION BY p.task_id, p.page_no ORDER BY updated_at DESC, run_id DESC) = 1""",
)
def page_latest_run_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_run_of_pages(task_pages(spark, sf_dir), runs(spark, sf_dir))


@register("run_fan_out", f"WITH {RUNS}, {TASK_PAGES}, g AS (SELECT *, (row_number() OVER (PARTITION BY task_id ORDER BY page_no) - 1) // 4 AS g FROM task_pages) SELECT task_id, min(page_no) AS start_page, max(page_no) AS end_page, count(*) AS page_count FROM g GROUP BY task_id, g")
def run_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fan_out(task_pages(spark, sf_dir), 4)


@register("rerun_failed", f"WITH {RUNS} SELECT 'rerun-' || run_id AS run_id, task_id, run_type, start_page, end_page, 'running' AS status FROM runs WHERE status = 'failed'")
def rerun_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rerun(runs(spark, sf_dir))


@register("summary_run_inputs", f"WITH {RUNS} SELECT task_id, count(*) AS inputs, min(start_page) AS start_page, max(end_page) AS end_page, CAST(bool_or(status = 'needs_review') AS INT) AS needs_review FROM runs WHERE run_type <> 'summary' AND status IN ('completed', 'needs_review') GROUP BY task_id")
def summary_run_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary_inputs(runs(spark, sf_dir))


@register("skill_stats", f"WITH {RUNS} SELECT template_id, count(*) FILTER (run_purpose = 'extract') AS sample_count, count(*) AS run_count, arg_max(status, row(updated_at, run_id)) AS latest_status, strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS latest_at FROM runs GROUP BY template_id")
def skill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("updated_at", "run_id", "status"))
    found = runs(spark, sf_dir).groupBy("template_id").agg(F.sum((F.col("run_purpose") == "extract").cast("long")).alias("sample_count"), F.count("*").alias("run_count"), last.alias("x"))
    return found.select("template_id", "sample_count", "run_count", F.col("x.status").alias("latest_status"), F.date_format("x.updated_at", "yyyy-MM-dd HH:mm:ss").alias("latest_at"))


@register("customer_counts", "WITH d AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT coalesce(d.k, t.k) AS customer_id, coalesce(d.n, 0) AS documents, coalesce(t.n, 0) AS tasks FROM d FULL JOIN t ON d.k = t.k")
def customer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts_by_customer(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("customer_id")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("customer_id")))


@register("overview_counts", "SELECT count(*) AS tasks, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'O') AS open_tasks, strftime(max(o_orderdate), '%Y-%m-%d') AS updated FROM orders")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("tasks"), F.countDistinct("o_custkey").alias("customers"), F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("open_tasks"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("updated"))


@register("paged_list", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority || ' ' || o_orderstatus), 'high') QUALIFY position BETWEEN 41 AND 60")
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).contains("high")
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & keyword)
    return R.paged(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 20).select("o_orderkey", "o_custkey", "position")


@register("latest_and_bounded", f"WITH {RUNS} SELECT task_id, run_id, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC, run_id DESC) AS place FROM runs QUALIFY place <= 8")
def latest_and_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("updated_at"), F.desc("run_id")))
    return runs(spark, sf_dir).select("task_id", "run_id", place.alias("place")).where("place <= 8")


@register("task_detail_join", "SELECT o_orderkey AS task_id, c_name AS customer, coalesce(n, 0) AS pages, coalesce(v, 0) AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS v FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def task_detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("v"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = table(spark, sf_dir, "orders").join(people, "o_custkey", "left").join(lines, "o_orderkey", "left")
    return out.select(F.col("o_orderkey").alias("task_id"), F.col("c_name").alias("customer"), F.coalesce("n", F.lit(0)).alias("pages"), F.coalesce("v", F.lit(0)).alias("value"))


_CALLS = """c AS (SELECT event_id, user_id, event_type, ts, '{"q": ' || event_id || '}' AS request, CASE WHEN event_id % 4 <> 0 THEN '{"usage": {"prompt_tokens": ' || (event_id % 50) || '}, "choices": [{"message": {"content": "' || event_type || '"}}]}' END AS response FROM events)"""


@register(
    "llm_trace_rows",
    f"""WITH {_CALLS}, r AS (SELECT *, 0 AS i FROM c UNION ALL SELECT event_id, user_id, NULL, ts, CASE WHEN event_id % 5 = 0 THEN request END, NULL, 1 FROM c)
      SELECT 'llm-trace-' || substr(sha256(event_id || chr(31) || 'extract' || chr(31) || i), 1, 12) AS trace_id, event_id AS run_id, CASE WHEN i = 0 THEN event_type ELSE 'request-2' END AS kind, CAST(CASE WHEN i = 0 AND event_id % 3 = 0 THEN 7 ELSE length(request) END AS INT) AS input_chars,
        CAST(CASE WHEN i = 0 AND event_id % 4 <> 0 THEN length(event_type) ELSE 0 END AS INT) AS output_chars, CAST(CASE WHEN response IS NOT NULL THEN event_id % 50 END AS INT) AS prompt_tokens,
        'traces/' || event_id || '/llm-trace-' || substr(sha256(event_id || chr(31) || 'extract' || chr(31) || i), 1, 12) || '-request.json' AS request_key FROM r WHERE request IS NOT NULL OR response IS NOT NULL""",
)
def llm_trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests an event, of which the second has a payload in one of five."""
    from leafline.streaming import traces as S

    e = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    request = text('{"q": ', e, "}")
    response = F.when(e % 4 != 0, text('{"usage": {"prompt_tokens": ', e % 50, '}, "choices": [{"message": {"content": "', F.col("event_type"), '"}}]}'))
    none = [F.lit(None).cast("int")] * 5
    first = F.struct(F.col("event_type"), request, response, F.when(e % 3 == 0, 7), *none)
    second = F.struct(F.lit(None).cast("string"), F.when(e % 5 == 0, request), F.lit(None).cast("string"), *none, F.lit(None).cast("int"))
    names = "struct<kind:string,request:string,response:string,input_chars:int,output_chars:int,prompt_tokens:int,completion_tokens:int,total_tokens:int,duration_ms:int>"
    logs = table(spark, sf_dir, "events").select(e.alias("run_id"), F.col("user_id").alias("task_id"), F.lit("extract").alias("stage"), F.lit(None).cast("string").alias("mode"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.col("ts").alias("updated_at"), F.array(first.cast(names), second.cast(names)).alias("requests"))
    return S.trace_rows(logs).select("trace_id", "run_id", "kind", "input_chars", "output_chars", "prompt_tokens", "request_key")
