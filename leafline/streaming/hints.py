"""Hints that users confirm, kept for each profile: the last eight, with the terms that follow from them.

A hint is told by its id: repeated ones count once, at their latest time, and
hints of equal time stand by id. What is kept depends on the set of events only, so
late and repeated events and batches that run again change nothing, and the
stream ends with what ``profiles`` gives for all events at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafline.functions.text import useful_terms

#: Most hints of a profile, terms of a hint and windows of a hint.
HINTS, TERMS, WINDOWS = 8, 48, 4

_HINT = "hint_id string, at timestamp, output_type string, terms array<string>"


def hints_of(candidates: DataFrame) -> DataFrame:
    """The hint that each confirmed candidate gives: ``profile_id, hint_id, at, output_type, terms, window, windows``.

    ``candidates`` has ``profile_id, candidate_id, confirmed_at, type,
    matched_terms, row_window`` and ``matched_windows``. Blank terms go; the window is the
    candidate's own, else the first that matched.
    """
    terms = F.slice(F.filter(F.coalesce("matched_terms", F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, TERMS)
    windows = F.slice(F.filter("matched_windows", lambda x: x.isNotNull()), 1, WINDOWS)
    return candidates.select("profile_id", F.col("candidate_id").alias("hint_id"), F.col("confirmed_at").alias("at"), F.col("type").alias("output_type"), terms.alias("terms"), F.coalesce("row_window", F.get(windows, F.lit(0))).alias("window"), windows.alias("windows"))


def _derived(kept: DataFrame, most: int) -> DataFrame:
    return kept.select("profile_id", "hint_ids", useful_terms(F.col("terms"), most).alias("terms"), "updated_at")


def profiles(hints: DataFrame, most: int = HINTS, terms: int = TERMS) -> DataFrame:
    """What each profile keeps of all its hints: ``profile_id, hint_ids`` (oldest first), ``terms, updated_at``.

    Repeated hints are one before they are ranked; of a profile of any size no
    more than ``most`` rows a task are exchanged for the ranks. Hints without id
    or time go.
    """
    held = hints.where(F.col("hint_id").isNotNull() & F.col("at").isNotNull())
    once = held.groupBy("profile_id", "hint_id").agg(F.max("at").alias("at"), F.max_by(F.coalesce("terms", F.array().cast("array<string>")), "at").alias("terms"))
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("at"), F.desc("hint_id")))
    last = once.withColumn("_place", place).where(F.col("_place") <= most)
    listed = last.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("at", "hint_id", "terms"))).alias("x"))
    return _derived(listed.select("profile_id", F.transform("x", lambda h: h["hint_id"]).alias("hint_ids"), F.flatten(F.transform("x", lambda h: h["terms"])).alias("terms"), F.array_max(F.transform("x", lambda h: h["at"])).alias("updated_at")), terms)


class LastHints(StatefulProcessor):
    """A profile's state: its last hints, never more than ``most``, however many events come at once."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", _HINT)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = {h[0]: tuple(h) for h in self.kept.get()}
        held = dict(before)
        for batch in rows:
            for hint in batch[["hint_id", "at", "output_type", "terms"]].itertuples(index=False, name=None):
                if hint[0] is None or pd.isna(hint[1]):
                    continue
                if hint[0] not in held or pd.Timestamp(held[hint[0]][1]) < hint[1]:
                    held[hint[0]] = (hint[0], hint[1].to_pydatetime(), hint[2], [] if hint[3] is None else list(hint[3]))
            held = {h[0]: h for h in sorted(held.values(), key=self._order)[-self.most :]}
        if not held or held == before:
            return
        hints = sorted(held.values(), key=self._order)
        self.kept.put(hints)
        yield pd.DataFrame({"profile_id": [key[0]], "hint_ids": [[h[0] for h in hints]], "terms": [[t for h in hints for t in h[3]]], "updated_at": [pd.Timestamp(hints[-1][1])]})

    @staticmethod
    def _order(hint: tuple) -> tuple:
        return pd.Timestamp(hint[1]), hint[0]

    def close(self) -> None:
        pass


def profile_updates(hints: DataFrame, most: int = HINTS, terms: int = TERMS) -> DataFrame:
    """A stream of hints as a stream of what their profiles keep, a row whenever that changes, for update mode.

    ``profile_id`` and ``hint_id`` are strings. The session's state store must be RocksDB
    (``spark.sql.streaming.stateStore.providerClass``), which keyed state needs.
    """
    held = hints.select("profile_id", "hint_id", "at", "output_type", "terms")
    kept = held.groupBy("profile_id").transformWithStateInPandas(LastHints(most), "profile_id string, hint_ids array<string>, terms array<string>, updated_at timestamp", "Update", "None")
    return _derived(kept, terms)
