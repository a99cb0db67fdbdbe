"""Stretches of words that repeat a shorter stretch over and over, by suffix trees of texts.

A text's suffix tree is the sorted order of its suffixes with the words that
neighbours have in common. At each of its branchings the leaves of the smaller
side are looked at: a leaf whose place lies as many words from a leaf of the
other side as the branching is deep begins or ends a branching tandem repeat,
two copies behind which the text goes on otherwise than with a third. Rotated to
the left as far as the words agree, each is a maximal run; runs of the same
stretch with several periods are one, with the smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm.runindex import spread
from leafline.llm.runtime import short_batches


class Suffixes:
    """Sorted suffixes of texts laid one behind the other, none of which goes beyond its text.

    ``levels[k]`` ranks the stretches of 2^k words from all places, so two
    stretches are compared in as many steps as their length has bits.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, deepest: int | None = None):
        """``words`` are numbers from 0; ranks go on to stretches of ``deepest`` words, or until no two are alike."""
        n = len(words)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words up to the text's end
        key = (np.repeat(np.arange(len(sizes)), sizes).astype(np.int64) << 32) | words
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n + 1, np.int32)
        rank[n] = -1
        rank[self.order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels = [rank.copy()]
        size = 1
        while deepest is None or size < deepest:
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            members = self.order[slots]
            behind = np.where(self.left[members] > size, rank[np.minimum(members + size, n)].astype(np.int64) + 1, 0)
            key = rank[members].astype(np.int64) * (n + 2) + behind
            by = np.argsort(key, kind="stable")
            members, key = members[by], key[by]
            self.order[slots] = members
            fresh = np.ones(len(slots), bool)
            fresh[1:] = key[1:] != key[:-1]
            new[slots] = fresh
            rank[members] = np.maximum.accumulate(np.where(fresh, slots, 0))
            self.levels.append(rank.copy())
            size *= 2
        #: Places where a stretch begins that also begins elsewhere, at the last level.
        tied = ~new
        tied[:-1] |= ~new[1:]
        self.alike = self.order[tied]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the texts from ``a`` and ``b`` have in common."""
        found, n = np.zeros(len(a), np.int64), len(self.order)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, x, y = self.levels[k], np.minimum(a + found, n), np.minimum(b + found, n)
            found += np.where((rank[x] == rank[y]) & (x < n), 1 << k, 0)
        return found

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the texts up to ``a`` and ``b``, both exclusive, have in common; ``a`` < ``b``."""
        found = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, x, y = self.levels[k], a - found - (1 << k), b - found - (1 << k)
            found += np.where((x >= 0) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)]), 1 << k, 0)
        return found


def sides(shared: list[int]) -> tuple[list[int], list[int]]:
    """For each place, the nearest place before it with a smaller value, and behind it with a value no greater (-1 and the length where there is none)."""
    before, behind, open_ = [-1] * len(shared), [len(shared)] * len(shared), []
    for i, x in enumerate(shared):
        while open_ and shared[open_[-1]] >= x:
            behind[open_.pop()] = i
        before[i] = open_[-1] if open_ else -1
        open_.append(i)
    return before, behind


def branching_repeats(tree: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and period of every branching tandem repeat.

    A place between two sorted suffixes is a branching of the tree (of one with
    several children it parts one child from those before), as deep as they agree.
    """
    order, n = tree.order, len(tree.order)
    shared = np.zeros(n, np.int64)
    shared[1:] = tree.ahead(order[:-1], order[1:])
    before, behind = map(np.array, sides(shared.tolist()))
    at = np.flatnonzero(shared > 0)
    depth, low, high = shared[at], before[at], behind[at]  # leaves low .. at-1 on one side, at .. high-1 on the other
    first_smaller = at - low <= high - at
    start = np.where(first_smaller, low, at)
    size = np.where(first_smaller, at - low, high - at)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    begins, periods = [], []
    edges = np.append(0, np.cumsum(size))
    a = 0
    while a < len(at):  # some million leaves at a time
        z = max(a + 1, int(np.searchsorted(edges, edges[a] + (1 << 20), side="right")) - 1)
        leaf = order[spread(start[a:z], size[a:z])]
        of = np.repeat(np.arange(a, z), size[a:z])
        other_low, other_high = np.where(first_smaller, at, low)[of], np.where(first_smaller, high, at)[of]
        for sign in (1, -1):
            mate = leaf + sign * depth[of]
            inside = (mate >= 0) & (mate < n)
            r = rank[np.clip(mate, 0, n - 1)]
            hit = inside & (r >= other_low) & (r < other_high)
            begins.append(np.minimum(leaf, mate)[hit])
            periods.append(depth[of][hit])
        a = z
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *begins]), np.concatenate([none, *periods])


def maximal_runs(words: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every maximal run of ``least`` words and ``times`` periods or more, by start, then period.

    Such a run's first stretch of ``least - least // times`` words returns a
    period later, so texts without a stretch of this length twice have no tree
    that is deep enough and are left after as many doublings.
    """
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    tree = Suffixes(words, sizes, deepest=1 << ((least - least // times).bit_length() - 1))
    text = np.repeat(np.arange(len(sizes)), sizes)
    deep = np.zeros(len(sizes), bool)
    deep[text[tree.alike]] = True
    if not deep.any():
        return none, none, none
    base = (np.cumsum(sizes) - sizes)[deep]
    tree = Suffixes(words[deep[text]], sizes[deep])
    begin, period = branching_repeats(tree)
    rotated = tree.back(begin, begin + period)
    start, length = begin - rotated, 2 * period + rotated
    long = (length >= least) & (length >= times * period)
    start, length, period = start[long], length[long], period[long]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, period = start[first], length[first], period[first]
    packed = np.cumsum(sizes[deep]) - sizes[deep]
    start = start + (base - packed)[np.searchsorted(packed, start, side="right") - 1]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, block_words: int = 200_000) -> DataFrame:
    """Per row its id (as ``id``), ``n_words``, ``runs`` and the ``collapsed`` text.

    Words are what lies between spaces, tabs and line ends (ASCII); ``edit`` may
    give others for a row's id and words before the search. ``runs``
    holds ``start, length, period`` in words of each stretch with that smallest
    period which no neighbouring word extends, of ``least`` words and ``times``
    periods or more, by start, then period. ``collapsed`` leaves each run's first
    period of words alone (words that another run drops go all the same), joined
    by one space.

    Null texts have no words. Repeated rows and rows without an id come back
    each; extra columns are ignored; an empty table gives an empty result.
    Texts are worked on in blocks of about ``block_words`` words, a longer one by
    itself, whose memory grows with its words times the bits of its longest repeat.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
            known: dict[bytes, int] = {}
            sizes = np.array([len(x) for x in texts], np.int64)
            words = np.fromiter((known.setdefault(w, len(known)) for x in texts for w in x), np.int64, int(sizes.sum()))
            start, length, period = maximal_runs(words, sizes, least, times)
            ends = np.cumsum(sizes)
            cuts = np.searchsorted(start, np.append(0, ends))
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            gone = np.cumsum(drop[:-1]) > 0
            runs, kept = [], []
            for i, x in enumerate(texts):
                a, z, begin = cuts[i], cuts[i + 1], int(ends[i] - sizes[i])
                mine = [{"start": s - begin, "length": n, "period": p} for s, n, p in zip(start[a:z].tolist(), length[a:z].tolist(), period[a:z].tolist(), strict=True)]
                runs.append(mine)
                kept.append(b" ".join([w for w, g in zip(x, gone[begin : begin + len(x)].tolist(), strict=True) if not g] if mine else x))
            return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(runs, span), pa.array(kept, pa.binary())], ["id", "n_words", "runs", "collapsed"])

        for batch in batches:
            first, texts, total = 0, [], 0
            for i in range(batch.num_rows):
                x = (batch.column(1)[i].as_py() or b"").split()
                x = edit(batch.column(0)[i].as_py(), x) if edit else x
                if texts and total + len(x) > block_words:
                    yield block(batch.column(0).slice(first, len(texts)), texts)
                    first, texts, total = i, [], 0
                texts.append(x)
                total += len(x)
            if texts:
                yield block(batch.column(0).slice(first, len(texts)), texts)

    short_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    found = given.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run with most periods in its length, the first of equal ones; null where there is none."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, x: F.when(better(best, x), x).otherwise(best))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of one document in ten by its id with a tail that repeats a stretch of them."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + period] * -(-(n - a) // period))[:n]
