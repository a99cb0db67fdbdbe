"""Document quality by FTRL logistic regression over hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.llm.linear import Linear, fit, held_out
from leafline.llm.runtime import Sent, plus


def score(docs: DataFrame, model: Linear, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; a null text scores as an empty one, a ``score`` that ``docs`` has is replaced."""
    docs = docs.drop("score")
    held = Sent(docs.sparkSession, model)
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins, _ = held.value.margins(batch.column(text_at))
            p = 1 / (1 + np.exp(-np.clip(margins[:, 0], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, plus(docs.schema, score=T.DoubleType()))


def predict_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 10_000) -> DataFrame:
    """Learn from labels not held out and score every document.

    Returns ``doc_id, held_out, score, predicted``. Labels other than 0 and 1,
    or without an id, are not learned from; without any label every score is
    0.5. Empty texts get the intercept's score. Null ids count as not held out,
    repeated rows each get their result, extra columns are ignored.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col))
    model = fit(docs, known.select(id_col, F.array(F.col(label_col)).alias("y")), id_col, text_col, 1, sample_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    found = score(rows, model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
