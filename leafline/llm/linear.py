"""Logistic regression over hashed word n-grams, trained with FTRL-proximal.

A text's features are its single words and its pairs of neighbouring words
(letters, digits and other signs being words of their own, case kept), each
hashed to one of ``2 ** bits`` places. A score is a sparse dot product divided
by the root of the number of features, plus an intercept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm.hashing import pairs, raw, slices, words


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all features, the bounds of each text's, and each text's number of white-space words."""
    single, owner = words(texts, by_kind=True)
    double, of = pairs(single, owner)
    shift = np.uint64(64 - bits)
    places = np.concatenate([single >> shift, double >> shift]).astype(np.int32)
    owners = np.concatenate([owner, of])
    order = np.argsort(owners, kind="stable")
    data, ends = raw(texts)
    blank = np.isin(data, np.array([0x20, 9, 10, 11, 12, 13], np.uint8)) if len(data) else np.zeros(0, bool)
    starts = ~blank
    if len(data):
        starts[1:] &= blank[:-1] | np.isin(np.arange(1, len(data)), ends[:-1])
    counted = np.concatenate([[0], np.cumsum(starts)])
    return places[order], np.searchsorted(owners[order], np.arange(len(texts) + 1)), np.diff(counted[ends])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for ``outputs`` logistic regressions."""

    def __init__(self, bits: int, outputs: int, alpha: float = 8.0, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((outputs, (1 << bits) + 1)), np.zeros((outputs, (1 << bits) + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        return w

    def learn(self, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """One example: its places ``at`` (the last is the intercept) with values ``x``, and 0 or 1 for each output."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y)[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


@dataclass(frozen=True)
class Linear:
    """Weights, an output a row, the intercept last."""

    bits: int
    weights: np.ndarray

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each text by output, and its number of white-space words."""
        n, outputs = len(texts), len(self.weights)
        out, counts = np.zeros((n, outputs)), np.zeros(n, np.int64)
        for start, part in slices(texts):
            places, bounds, counted = features(part, self.bits)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            counts[start : start + len(part)] = counted
            for k in range(outputs):
                if len(some):
                    sums = np.add.reduceat(self.weights[k].take(places), bounds[some], dtype=np.float64)
                    out[start + some, k] = sums / np.sqrt(size[some])
        return out + self.weights[:, -1].astype(float), counts


def held_out(id_col: str) -> Column:
    """Whether a row's label is kept from learning: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, outputs: int, sample_rows: int = 10_000, bits: int = 18, epochs: int = 3) -> Linear:
    """Fit on a sample of ``labels`` (``id_col``, ``y`` an array of ``outputs`` numbers 0 or 1).

    About ``sample_rows`` labels are drawn by a hash of their id (all of them,
    if there are fewer), so the sample that one task learns from is bounded and
    doesn't depend on how rows are stored. The task holds all features of these
    rows, so its memory grows with the length of their texts, not with the
    table. An empty sample gives zero weights.
    """
    spread = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(6)), F.lit(1 << 30))
    given = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), "y", spread.alias("_h"))
    total = given.count()
    if total > sample_rows:
        given = given.where(F.col("_h") < int(sample_rows / total * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # the sample's ids are bounded by sample_rows, so they are sent to where the texts are
    # one row an id and label: however often an id is repeated, the sample stays bounded
    met = texts.join(F.broadcast(given), "_id").groupBy("_h", "_id", "y").agg(F.min("text").alias("text"))
    rows = met.select("_h", "_id", "text", "y").repartition(1).sortWithinPartitions("_h", "_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            ys = np.array(batch.column(3).to_pylist(), float).reshape(-1, outputs)
            for start, part in slices(batch.column(2)):
                places, bounds, _ = features(part, bits)
                for i in range(len(part)):
                    at, n = np.unique(places[bounds[i] : bounds[i + 1]], return_counts=True)
                    x = np.append(n / np.sqrt(max(1, n.sum())), 1.0).astype(np.float32)
                    held.append((np.append(at, 1 << bits).astype(np.int32), x, ys[start + i]))
        model = Ftrl(bits, outputs)
        for epoch in range(epochs):
            for i in np.random.Generator(np.random.PCG64(epoch)).permutation(len(held)):
                model.learn(*held[i])
        found = model.weights().astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(list(range(outputs)), pa.int32()), pa.array([w.tobytes() for w in found], pa.binary())], ["k", "w"])

    got = sorted(rows.mapInArrow(run, "k int, w binary").collect())  # one row an output
    return Linear(bits, np.stack([np.frombuffer(r["w"], np.float32) for r in got]) if got else np.zeros((outputs, (1 << bits) + 1), np.float32))
