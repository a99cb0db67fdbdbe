"""Runs, traces, tasks and page ranges: latest records, roll-ups, paging.

Latest-of-a-group questions are grouped maxima over a struct, so partial
aggregation happens before the shuffle and no window has to hold a group.
Page ranges are expanded to the pages they cover and joined by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys under which a newer run replaces an older one.
REPOSITORY_KEY = ("task_id", "run_type", "start_page", "end_page", "run_purpose", "template_id", "prompt_name")
BUILDER_KEY = ("task_id", "run_type", "start_page", "end_page", "prompt_name")
RESULT_KEY = ("task_id", "run_type", "start_page", "end_page", "run_purpose")
FINISHED = ("completed", "needs_review")
SLOW_MS = 30_000


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The row of each group that is greatest by ``order``: ``keys`` and ``keep``."""
    best = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("_best")
    found = rows.groupBy(*keys).agg(best)
    return found.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in keep])


def latest_effective(runs: DataFrame, keys: Sequence[str] = REPOSITORY_KEY, keep: Sequence[str] = ("run_id", "status")) -> DataFrame:
    """The newest run of each key; the run id breaks ties."""
    return latest(runs, keys, ("updated_at", "run_id"), keep)


def latest_results(runs: DataFrame) -> DataFrame:
    """The newest finished run of each result key."""
    return latest_effective(runs.where(F.col("status").isin(*FINISHED)), RESULT_KEY)


def latest_object_operations(runs: DataFrame) -> DataFrame:
    """The newest finished post-process run of each page and target."""
    done = runs.where((F.col("run_purpose") == "post_process") & F.col("status").isin(*FINISHED))
    return latest(done, ("task_id", "start_page", "template_id"), ("updated_at", "run_id"), ("run_id", "status"))


def status_of(status: Column) -> Column:
    """One status of a group: running, failed, needs_review, completed if all are, else pending."""

    def some(value: str) -> Column:
        return F.max(F.when(status == value, 1).otherwise(0)) == 1

    whole = F.min(F.when(status == "completed", 1).otherwise(0)) == 1
    return F.when(some("running"), "running").when(some("failed"), "failed").when(some("needs_review"), "needs_review").when(whole, "completed").otherwise("pending")


def status_rollup(runs: DataFrame, by: Sequence[str], keys: Sequence[str] = REPOSITORY_KEY) -> DataFrame:
    """The status of each group by its latest effective runs alone, and how many runs it has in all."""
    newest = latest_effective(runs, [*dict.fromkeys([*by, *keys])], ("run_id", "status"))
    status = newest.groupBy(*by).agg(status_of(F.col("status")).alias("status"))
    counts = runs.groupBy(*by).agg(F.count("*").alias("run_count"))
    return status.join(counts, list(by)).select(*by, "status", "run_count")


def trace_rollup(traces: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calls, slow calls, summed times and tokens, and the latest model and status of each group.

    Token sums are null where no call of the group knows its tokens.
    """
    ms = F.coalesce(F.when(F.col("total_ms") != 0, F.col("total_ms")), "http_ms", F.lit(0))
    last = F.max(F.struct("updated_at", "run_id", "model", "status"))
    found = traces.groupBy(*by).agg(
        F.count("*").alias("call_count"),
        F.sum(F.when(ms >= SLOW_MS, 1).otherwise(0)).cast("long").alias("slow_count"),
        F.sum(F.coalesce("total_ms", F.lit(0))).cast("long").alias("total_ms"),
        F.sum("prompt_tokens").cast("long").alias("prompt_tokens"),
        F.sum("completion_tokens").cast("long").alias("completion_tokens"),
        last.alias("_last"),
    )
    return found.select(*by, "call_count", "slow_count", "total_ms", "prompt_tokens", "completion_tokens", F.col("_last.model").alias("latest_model"), F.col("_last.status").alias("latest_status"))


def refresh_tasks(runs: DataFrame) -> DataFrame:
    """What a task shows of its runs: count, status of the effective ones, time and a short summary.

    The summary is the latest summary text, else the latest page text, else the
    latest error, cut to 180 characters.
    """

    def newest(value: Column, where: Column) -> Column:
        return F.max(F.when(where & (F.length(value) > 0), F.struct("updated_at", "run_id", value.alias("v"))))["v"]

    summary = F.col("run_type") == "summary"
    found = runs.groupBy("task_id").agg(
        F.count("*").alias("run_count"),
        F.max("updated_at").alias("updated_at"),
        newest(F.col("output_text"), summary).alias("a"),
        newest(F.col("output_text"), ~summary).alias("b"),
        newest(F.col("error_message"), F.lit(True)).alias("c"),
    )
    found = found.join(status_rollup(runs, ("task_id",)).select("task_id", "status"), "task_id")
    return found.select("task_id", "run_count", "status", "updated_at", F.substring(F.coalesce("a", "b", "c", F.lit("")), 1, 180).alias("summary"))


def runtime_rollup(runs: DataFrame) -> DataFrame:
    """Per task: latest run, status of page and summary runs, failed and completed pages."""
    last = latest(runs, ("task_id",), ("updated_at", "run_id"), ("run_id", "prompt_name", "start_page", "end_page"))
    label = F.concat_ws(" ", "prompt_name", page_range(F.col("start_page"), F.col("end_page")))
    effective = latest_effective(runs, BUILDER_KEY)
    summary = F.col("run_type") == "summary"

    def status(part: Column) -> Column:
        return status_of(F.when(part, F.col("status")))

    counts = effective.groupBy("task_id").agg(
        F.sum((~summary).cast("int")).alias("page_runs"),
        F.sum(summary.cast("int")).alias("summary_runs"),
        F.sum((~summary & (F.col("status") == "failed")).cast("int")).cast("long").alias("failed_pages"),
        F.sum((~summary & (F.col("status") == "completed")).cast("int")).cast("long").alias("completed_pages"),
    )
    pages = effective.where(~summary).groupBy("task_id").agg(status_of(F.col("status")).alias("page_status"))
    sums = effective.where(summary).groupBy("task_id").agg(status_of(F.col("status")).alias("summary_status"))
    out = last.join(counts, "task_id").join(pages, "task_id", "left").join(sums, "task_id", "left")
    return out.select("task_id", "run_id", label.alias("label"), F.coalesce("page_status", F.lit("pending")).alias("page_status"), F.coalesce("summary_status", F.lit("pending")).alias("summary_status"), "failed_pages", "completed_pages")


def page_range(start: Column, end: Column) -> Column:
    """``3`` or ``3-5``."""
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def covered(ranges: DataFrame, start: str = "start_page", end: str = "end_page", page: str = "page_no") -> DataFrame:
    """``ranges`` with a row for each page they cover."""
    return ranges.where(F.col(start) <= F.col(end)).withColumn(page, F.explode(F.sequence(start, end)))


def configs_on_pages(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """Every page with the config that covers it, the one updated last if several."""
    last = latest(covered(configs), ("task_id", "page_no"), ("updated_at", "config_id"), ("config_id", "prompt_name", "start_page", "end_page"))
    return pages.join(last, ["task_id", "page_no"], "left")


def latest_run_of_pages(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Every page with the newest finished run whose range covers it, if any."""
    last = latest(covered(runs.where(F.col("status").isin(*FINISHED))), ("task_id", "page_no"), ("updated_at", "run_id"), ("run_id", "run_type"))
    return pages.join(last, ["task_id", "page_no"], "left")


def paged(rows: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """Rows of one page of an ordered list, with their place in it."""
    size = min(max(size, 1), 100)
    first = (page - 1) * size
    # offset and limit keep the sort distributed; only the page's rows meet
    chosen = rows.orderBy(*order).offset(first).limit(size)
    return chosen.withColumn("position", F.row_number().over(Window.orderBy(*order)) + first)


def fan_out(pages: DataFrame, group_size: int) -> DataFrame:
    """Ranges of ``group_size`` pages in page order: ``task_id, start_page, end_page, page_count``."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("page_no")) - 1
    grouped = pages.withColumn("_g", F.floor(place / group_size)).groupBy("task_id", "_g")
    return grouped.agg(F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"), F.count("*").alias("page_count")).drop("_g")


def rerun(runs: DataFrame) -> DataFrame:
    """Failed runs as new running ones, under an id that follows from the old."""
    failed = runs.where(F.col("status") == "failed")
    return failed.select(F.concat(F.lit("rerun-"), F.col("run_id").cast("string")).alias("run_id"), "task_id", "run_type", "start_page", "end_page", F.lit("running").alias("status"))


def summary_inputs(runs: DataFrame) -> DataFrame:
    """Per task what a summary run reads: how many finished page runs, over which pages."""
    done = runs.where((F.col("run_type") != "summary") & F.col("status").isin(*FINISHED))
    return done.groupBy("task_id").agg(F.count("*").alias("inputs"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.max(F.when(F.col("status") == "needs_review", 1).otherwise(0)).alias("needs_review"))


def counts_by_customer(documents: DataFrame, tasks: DataFrame) -> DataFrame:
    """Documents and tasks of every customer that has either."""
    both = documents.select("customer_id", F.lit(1).alias("d"), F.lit(0).alias("t")).unionByName(tasks.select("customer_id", F.lit(0).alias("d"), F.lit(1).alias("t")))
    return both.groupBy("customer_id").agg(F.sum("d").cast("long").alias("documents"), F.sum("t").cast("long").alias("tasks"))
