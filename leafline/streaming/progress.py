"""Progress of runs as a stream: each event once, and what each task's latest one is.

State is bounded by the watermark for events and by the number of tasks for the
latest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def events_once(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of run events without those sent again within ``delay``."""
    return events.withWatermark("updated_at", delay).dropDuplicatesWithinWatermark(["run_id", "status", "updated_at"])


def latest_status(events: DataFrame) -> DataFrame:
    """The latest run and its status of each task so far, for update mode."""
    last = F.max(F.struct("updated_at", "run_id", "status")).alias("x")
    return events.groupBy("task_id").agg(last, F.count("*").alias("events")).select("task_id", F.col("x.run_id").alias("run_id"), F.col("x.status").alias("status"), "events")


def status_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """How many events of each status there were in each stretch of time, late ones within ``delay`` included."""
    held = events.withWatermark("updated_at", delay)
    return held.groupBy(F.window("updated_at", width).alias("w"), "status").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "status", "events")
