import os
from datetime import datetime

from leafline.streaming import progress, traces

ROWS = [(1, 10, "running", datetime(2024, 1, 1, 0, 5)), (1, 10, "running", datetime(2024, 1, 1, 0, 5)), (2, 10, "failed", datetime(2024, 1, 1, 1, 5)), (3, 11, "completed", datetime(2024, 1, 1, 0, 50))]
SCHEMA = "run_id long, task_id long, status string, updated_at timestamp"


def drained(spark, tmp_path, name, shape, mode):
    source = f"{tmp_path}/{name}-in"
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(source)
    query = shape(spark.readStream.schema(SCHEMA).parquet(source)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_each_event_once(spark, tmp_path):
    found = drained(spark, tmp_path, "once", progress.events_once, "append")
    assert [r[0] for r in found] == [1, 2, 3]


def test_latest_status(spark, tmp_path):
    assert drained(spark, tmp_path, "latest", progress.latest_status, "complete") == [(10, 2, "failed", 3), (11, 3, "completed", 1)]


def test_counts_by_time(spark, tmp_path):
    found = drained(spark, tmp_path, "counts", progress.status_counts, "complete")
    assert found == [(datetime(2024, 1, 1, 0), "completed", 1), (datetime(2024, 1, 1, 0), "running", 2), (datetime(2024, 1, 1, 1), "failed", 1)]


def calls(spark, rows):
    schema = f"run_id long, task_id long, stage string, mode string, provider string, model string, updated_at timestamp, requests {traces.REQUESTS}"
    return spark.createDataFrame(rows, schema)


def call(run, minute, *requests, mode=None):
    return (run, 1, "extract", mode, "p", "m", datetime(2024, 1, 1, 0, minute), [(*r, *[None] * (9 - len(r))) for r in requests])


def test_traces_of_logs(spark):
    answer = '{"usage": {"prompt_tokens": 5}, "choices": [{"message": {"content": "four"}}]}'
    found = traces.trace_rows(calls(spark, [call(1, 0, ("ask", "abc", answer), (None, None, None), (None, "x", None, 9, 8, 7, 6, 5, 4)), call(2, 0, (None, "q", None), mode="chat")])).orderBy("run_id", "kind").collect()
    assert [(r["run_id"], r["kind"], r["input_chars"], r["output_chars"], r["prompt_tokens"], r["completion_tokens"], r["total_ms"]) for r in found] == [(1, "ask", 3, 4, 5, None, None), (1, "request-3", 9, 8, 7, 6, 4), (2, "chat", 1, 0, None, None, None)]
    assert len({r["trace_id"] for r in found}) == 3 and found[1]["response_key"] is None


def test_traces_are_kept_once(spark, tmp_path):
    source, folder, state = f"{tmp_path}/logs", f"{tmp_path}/kept", f"{tmp_path}/state"

    def drain():
        schema = calls(spark, []).schema
        query = traces.persisted(traces.trace_rows(spark.readStream.schema(schema).parquet(source)), folder, state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r["run_id"], r["input_chars"], r["updated_at"].minute) for r in traces.kept(spark, folder).collect())

    first = calls(spark, [call(1, 1, ("a", "abc", None)), call(1, 1, ("a", "abc", None)), call(2, 5, ("a", "b", None))])
    first.coalesce(1).write.parquet(source)
    assert drain() == [(1, 3, 1), (2, 1, 5)]
    # run 1 comes again later and longer, run 2 late and shorter
    calls(spark, [call(1, 9, ("a", "abcdef", None)), call(2, 2, ("a", "", None))]).coalesce(1).write.mode("append").parquet(source)
    assert drain() == [(1, 6, 9), (2, 1, 5)]
    # a batch whose end was never noted runs again
    last = max(int(x) for x in os.listdir(f"{state}/commits") if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{state}/commits/{name}")
    assert drain() == [(1, 6, 9), (2, 1, 5)]
    assert sorted(x for x in os.listdir(folder) if x.startswith("batch=")) == ["batch=0", "batch=1"]
