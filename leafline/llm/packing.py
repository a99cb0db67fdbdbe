"""Best-two-fit packing of tokenised documents into sequences of fixed length.

How to pack depends on the lengths alone, so the packing is worked out on the
histogram of lengths (as many rows as a sequence has tokens, at most): a bin is
filled greedily, its smallest document gives way to two unpacked ones that fit
its expanded gap more tightly, and the pattern found is repeated while the
lengths last. Pieces then take their places in the patterns by their rank among
the pieces of the same length.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.llm.runtime import cut, plus

END = 2


def encoder(vocabulary: str, pattern: str, added: dict[str, int]):
    """A byte-level BPE encoder from a file of ranks; ``added`` tokens in a text become their ids."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, which stand for themselves wherever a text holds them."""
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``total`` tokens: only the first may be short."""
    head = total % capacity or min(total, capacity)
    return [(0, head), *((start, capacity) for start in range(head, total, capacity))]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizers_folder: str | None = None) -> DataFrame:
    """Per piece of each document: ``doc_id, piece, start, length, ids_crc32``.

    ``tokenizers_folder`` holds ``byte_bpe_50k.json`` and its rank file; by default the installed one.
    """
    schema = plus(docs.select(F.col(id_col).alias("doc_id")).schema, piece=T.IntegerType(), start=T.LongType(), length=T.LongType(), ids_crc32=T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        folder = tokenizers_folder or os.path.dirname(public_tokenizers.path(""))
        added = added_tokens(os.path.join(folder, "byte_bpe_50k.json"))
        coder = encoder(os.path.join(folder, "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*coder.encode(text.as_py() or "", allowed_special="all"), END], "<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append(row)
                    out.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            made = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(made[0].astype(np.int32)), *map(pa.array, made[1:])], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-two-fit over ``{length: count}``: (repeats, lengths in a sequence) in order.

    Each step makes the bin that packing one document after the other would
    make next, as often as the lengths it takes allow.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    lengths = sorted(left)
    found = []
    while lengths:
        bin_, gap, used = [], capacity, Counter()

        def largest(most: int, used=used) -> int:
            at = bisect_right(lengths, most) - 1
            while at >= 0 and used[lengths[at]] >= left[lengths[at]]:
                at -= 1
            return lengths[at] if at >= 0 else 0

        while gap and (take := largest(gap)):
            fits = min(gap // take, left[take] - used[take])
            bin_ += [take] * fits
            used[take] += fits
            gap -= take * fits
        if gap and len(bin_) > 1 or gap and lengths[0] < bin_[0]:
            smallest = bin_[-1]
            used[smallest] -= 1
            room, best, pair = gap + smallest, smallest, None
            low, high = 0, bisect_right(lengths, room) - 1
            while low <= high:
                a, b = lengths[low], lengths[high]
                free = used[b] < left[b] and used[a] < left[a] and (a != b or used[a] + 2 <= left[a])
                if free and best < a + b <= room:
                    best, pair = a + b, [b, a]
                if a + b > room:
                    high -= 1
                else:
                    low += 1
            if pair:
                bin_[-1:] = pair
                used.update(pair)
            else:
                used[smallest] += 1
        used = +used
        repeats = min(left[length] // n for length, n in used.items())
        found.append((repeats, bin_))
        for length, n in used.items():
            left[length] -= repeats * n
            if not left[length]:
                del left[length]
                lengths.remove(length)
    return found


def places(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, sequence, offset, run) of the patterns.

    Rank r of a length lies in one row; it goes to ``sequence + (r - first) div
    run`` at ``offset + ((r - first) mod run) * length``.
    """
    rows, taken, sequence = [], Counter(), 0
    for repeats, bin_ in found:
        offset, runs = 0, Counter(bin_)
        for length, run in runs.items():
            rows.append((length, taken[length], taken[length] + repeats * run, sequence, offset, run))
            taken[length] += repeats * run
            offset += length * run
        sequence += repeats
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizers_folder: str | None = None, rows_in_group: int = 2000) -> DataFrame:
    """Every document, whole, in sequences of at most ``capacity`` tokens.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset``. A null or empty text is its end token alone. Null ids and repeated
    rows are packed like any other, each once; extra columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, id_col, text_col, capacity, tokenizers_folder))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = places(patterns(histogram, capacity))
    where = spark.createDataFrame(plan or [(0, 0, 0, 0, 0, 1)], "length long, first long, end long, sequence long, place long, run long")
    groups = max(1, -(-sum(histogram.values()) // rows_in_group))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # at most the square root of twice the capacity lengths a pattern, and a pattern uses up a length: bounded
    placed = ranked.join(F.broadcast(where), "length").where("rank >= first and rank < end")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("sequence + (rank - first) div run").alias("sequence_id"),
        F.expr("place + ((rank - first) % run) * length").alias("offset"),
    )
