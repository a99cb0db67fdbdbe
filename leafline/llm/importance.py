"""Importance of documents for a target text, by hashed runs of one to three words.

Each task sorts the suffixes of its texts by their first three words, as numbers.
Neighbours that agree on n words lie in one run of a repeated n-gram, so an n-gram
is hashed once a run and its bucket goes back to all its places. The buckets'
counts of the corpus and the target give each a gain, and a document the sum of
the gains of its places. Which documents are drawn follows from these sums and a
noise fixed by their ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm.runtime import Tables, short_batches

LONGEST = 3
#: Letters A-Z become small; all bytes but digits, small letters and those beyond ASCII part words.
WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


class Checksums:
    """CRC-32 of joined texts from those of their parts, as arrays.

    A text behind another one multiplies the other's checksum by a power of x
    that its length tells; for each length that comes up there are four tables
    of 256 numbers.
    """

    def __init__(self):
        one = np.empty(32, np.uint32)  # what a zero byte makes of each bit
        for bit in range(32):
            value = 1 << bit
            for _ in range(8):
                value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
            one[bit] = value
        self.powers = [one]  # of 2^k bytes
        self.known: dict[int, np.ndarray] = {}

    @staticmethod
    def times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        for bit in range(32):
            out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0)).astype(np.uint32)
        return out

    def table(self, length: int) -> np.ndarray:
        if length not in self.known:
            matrix, k = np.uint32(1) << np.arange(32, dtype=np.uint32), 0
            while length >> k:
                while len(self.powers) <= k:
                    self.powers.append(self.times(self.powers[-1], self.powers[-1]))
                if length >> k & 1:
                    matrix = self.times(self.powers[k], matrix)
                k += 1
            bytes_ = np.arange(256, dtype=np.uint32)
            self.known[length] = np.stack([self.times(matrix, bytes_ << np.uint32(8 * i)) for i in range(4)])
        return self.known[length]

    def joined(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Checksums of texts with ``first`` followed by texts of these ``lengths`` with ``second``."""
        values, which = np.unique(lengths, return_inverse=True)
        tables = np.stack([self.table(int(x)) for x in values]) if len(values) else np.zeros((1, 4, 256), np.uint32)
        if len(self.known) > 4096:
            self.known.clear()
        out = second.copy()
        for i in range(4):
            out ^= tables[which, i, (first >> np.uint32(8 * i) & np.uint32(255)).astype(np.int64)]
        return out


def buckets_of(words: list[bytes], sizes: np.ndarray, buckets: int, sums: Checksums) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the text each begins in; ``sizes`` are the texts' words.

    Words become numbers, suffixes are sorted by three of them, and what
    neighbours have in common tells where the runs of each n-gram begin.
    """
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int64, len(words))
    n, many = len(ids), len(known) + 1
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    padded = np.append(ids, [0, 0])
    symbols = [ids, np.where(left > 1, padded[1 : n + 1], 0), np.where(left > 2, padded[2 : n + 2], 0)]
    order = np.argsort((symbols[0] * many + symbols[1]) * many + symbols[2])
    alone = np.fromiter((zlib.crc32(w) for w in known), np.uint32, len(known))
    behind = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))
    length = np.fromiter(map(len, known), np.int64, len(known)) + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    agree = np.ones(max(0, n - 1), bool)  # with the suffix before, on the words so far
    found, owner = [], []
    for k in range(LONGEST):
        here = symbols[k][order]
        agree &= here[1:] == here[:-1]
        first = np.append(n > 0, ~agree)[:n]
        run = np.cumsum(first) - 1
        head = order[first]
        whole = symbols[k][head] > 0
        crc = alone[symbols[0][head] - 1]
        for j in range(1, k + 1):
            at = np.maximum(symbols[j][head] - 1, 0)
            crc = sums.joined(crc, behind[at], length[at])
        bucket = np.where(whole, crc.astype(np.int64) % buckets, -1)[run]
        kept = bucket >= 0
        found.append(bucket[kept])
        owner.append(text[order[kept]])
    return np.concatenate(found), np.concatenate(owner)


def blocks(batch: pa.RecordBatch, column: int, block_bytes: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Row numbers, words and words a text of some rows at a time.

    A longer text comes in parts, cut between words; each part but the last
    brings two words of the next, which begin nothing, and shows the row as
    negative: ``~row``.
    """
    rows, words, sizes = [], [], []
    total = 0
    for row in range(batch.num_rows):
        text = (batch.column(column)[row].as_py() or b"").translate(WORDS)
        if total and total + len(text) > block_bytes:
            yield np.array(rows), words, np.array(sizes, np.int64)
            rows, words, sizes, total = [], [], [], 0
        a, carried = 0, []
        while len(text) - a > block_bytes:
            z = text.find(b" ", a + block_bytes)
            if z < 0:
                break
            part = carried + text[a:z].split()
            if len(part) > LONGEST - 1:
                yield np.array([~row]), part, np.array([len(part)], np.int64)
                carried = part[-(LONGEST - 1) :]
            else:
                carried = part
            a = z
        mine = carried + (text[a:].split() if a else text.split())
        rows.append(row)
        words += mine
        sizes.append(len(mine))
        total += len(text) - a
    if rows:
        yield np.array(rows), words, np.array(sizes, np.int64)


def places(batch: pa.RecordBatch, column: int, buckets: int, block_bytes: int, sums: Checksums) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets and rows of all n-grams of a batch, with the rows and the words new in each block."""
    for rows, words, sizes in blocks(batch, column, block_bytes):
        if rows[0] < 0:  # without what begins at the last two words: the next part has that
            inner = np.array([len(words) - LONGEST + 1, LONGEST - 1])
            bucket, _ = buckets_of(words, np.array([len(words)]), buckets, sums)
            last, _ = buckets_of(words[inner[0] :], inner[1:], buckets, sums)
            counts = np.bincount(bucket, minlength=buckets) - np.bincount(last, minlength=buckets)
            bucket = np.repeat(np.arange(buckets), counts)
            yield bucket, np.full(len(bucket), ~rows[0]), ~rows, inner[:1]
        else:
            bucket, text = buckets_of(words, sizes, buckets, sums)
            yield bucket, rows[text] if len(text) else text, rows, sizes


def counted(texts: DataFrame, text_col: str, buckets: int, block_bytes: int) -> DataFrame:
    """Rows ``bucket, n`` over all texts: n-grams in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = Checksums(), np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, *_ in places(batch, 0, buckets, block_bytes, sums):
                counts += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    given = texts.select(F.col(text_col).cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """A bucket's thousandfold log of how much commoner it is in the target, one added to every bucket's count."""
    s, t = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * float(s + buckets) / ((corpus.get(b, 0) + 1) * float(t + buckets)))) for b in range(buckets)]


def weighed(docs: DataFrame, text_col: str, gain: list[int], block_bytes: int) -> DataFrame:
    """``docs`` (``id, text``) as ``id, n_words, n_features, weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, worth = Checksums(), np.array(gain, np.int64)
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for bucket, row, rows, sizes in places(batch, 1, len(gain), block_bytes, sums):
                np.add.at(words, rows, sizes)
                features += np.bincount(row, minlength=batch.num_rows)
                # sums of whole numbers well below 2^53 are exact
                weight += np.bincount(row, weights=worth[bucket], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], ["id", "n_words", "n_features", "weight"])

    given = docs.select("id", F.col(text_col).cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = 5,
    least_words: int = 20,
    buckets: int = 10_000,
    seed: str = "42",
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """Per document ``id, n_features, weight, score`` and its ``rank`` among the drawn ones, null for the others.

    Drawn are the ``percent`` of the documents with ``least_words`` words or more
    that score highest, ties to the smaller id. Null texts have no words; rows
    without an id draw their noise as ``null`` and come last among ties.
    Repeated rows count and come back each; without a target, or without
    documents, all counts are zero. Extra columns are ignored.

    To the driver come at most ``buckets`` counts of either side, and one of rows
    for each range of scores.
    """
    spark = docs.sparkSession
    short_batches(spark)
    tables = Tables(spark)
    sides = [{r["bucket"]: r["n"] for r in counted(x, c, buckets, block_bytes).collect()} for x, c in ((docs, text_col), (target, target_col))]
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = weighed(given, "text", gains(*sides, buckets), block_bytes)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    found = found.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))
    # ranges of scores in order; the last key spreads rows alike in all others
    order = [F.col("n_words") < least_words, F.desc("score"), F.asc_nulls_last("id"), "n_features", "tie"]
    scored = tables.put(found.withColumn("tie", F.monotonically_increasing_id()))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at, at + batch.num_rows))], names)
            at += batch.num_rows

    names = ["id", "n_words", "n_features", "weight", "score", "part", "at"]
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "n_words", "n_features", "weight", "score")
    placed = tables.put(placed.mapInArrow(numbered, "id long, n_words long, n_features long, weight long, score long, part int, at long"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("n_words") >= least_words).alias("long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range of scores
    totals = sizes.agg(F.sum("long").alias("long")).first()["long"] or 0
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.col("at") + 1
    drawn = percent * totals // 100
    return placed.join(F.broadcast(sizes), "part").select("id", "n_features", "weight", "score", F.when(rank <= drawn, rank).cast("long").alias("rank"))
