"""Traces of model calls: a row for each request of a log, and a sink that takes each of them once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: What a log's requests are: texts of both payloads and what was measured, null where it was not.
REQUESTS = "array<struct<kind:string,request:string,response:string,input_chars:int,output_chars:int,prompt_tokens:int,completion_tokens:int,total_tokens:int,duration_ms:int>>"


def trace_rows(logs: DataFrame) -> DataFrame:
    """A trace for each request with a payload: sizes, tokens, times and the keys of its payloads.

    ``logs`` has ``run_id, task_id, stage, mode, provider, model, updated_at``
    and ``requests``. A trace is named by its run, stage and place in the log, so
    a log read again gives the same names. What was not measured comes from the
    payloads: their lengths, and the tokens that the response's usage tells.
    """
    entries = logs.select("run_id", "task_id", "stage", "mode", "provider", "model", "updated_at", F.posexplode("requests").alias("i", "r"))
    held = entries.where(F.col("r.request").isNotNull() | F.col("r.response").isNotNull())
    name = F.concat(F.lit("llm-trace-"), F.substring(F.sha2(F.concat_ws("\x1f", F.col("run_id").cast("string"), "stage", F.col("i").cast("string")), 256), 1, 12))
    usage = lambda field: F.get_json_object("r.response", f"$.usage.{field}").cast("int")
    key = lambda side: F.when(F.col(f"r.{side}").isNotNull(), F.concat_ws("/", F.lit("traces"), F.col("run_id").cast("string"), F.concat(name, F.lit(f"-{side}.json"))))
    content = F.get_json_object("r.response", "$.choices[0].message.content")
    return held.select(
        name.alias("trace_id"), "run_id", "task_id", "stage", F.coalesce("r.kind", "mode", F.format_string("request-%d", F.col("i") + 1)).alias("kind"), "provider", "model", F.lit("completed").alias("status"),
        F.coalesce("r.input_chars", F.length("r.request"), F.lit(0)).alias("input_chars"), F.coalesce("r.output_chars", F.length(content), F.lit(0)).alias("output_chars"),
        *[F.coalesce(F.nullif(f"r.{x}", F.lit(0)), usage(x)).alias(x) for x in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.col("r.duration_ms").alias("total_ms"), key("request").alias("request_key"), key("response").alias("response_key"), "updated_at",
    )


def _latest(traces: DataFrame, *order: str) -> DataFrame:
    """The last row of each trace."""
    rest = [c for c in traces.columns if c not in ("trace_id", *order)]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("x")
    kept = [c for c in order if c != "batch"]
    return traces.groupBy("trace_id").agg(last, *[F.max_by(c, F.struct(*order)).alias(c) for c in kept]).select("trace_id", "x.*", *kept)


def persisted(traces: DataFrame, folder: str, state: str) -> DataStreamWriter:
    """A writer that keeps a stream of traces below ``folder``, each batch in a part of its own.

    A batch that runs again, after a failure before it was noted as done, writes
    the same part anew, so nothing is kept twice; traces that come again in a
    later batch are told apart when they are read.
    """

    def put(batch: DataFrame, number: int) -> None:
        _latest(batch, "updated_at").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return traces.writeStream.foreachBatch(put).option("checkpointLocation", state)


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """The traces below ``folder``: of each the latest, of equally late ones that of the last batch."""
    return _latest(spark.read.parquet(folder), "updated_at", "batch")
