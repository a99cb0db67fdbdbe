"""Near-duplicate vectors by counting collisions on one-dimensional projections.

Each vector is projected onto many random lines. On each line the vectors of a
block are sorted, and a query's window is the stretch around its own place. The
number of lines on which two vectors fall into each other's window is counted
for all pairs of two blocks at once, a bit a vector, and pairs that reach the
count are verified. Width and count follow from the recall that a pair just at
the limit must have, not from the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm.runtime import connected_components, cut
from leafline.llm.vectors import matrix, one_zero, units, usable

LINES = 64


def calibrated(limit: float, recall: float, lines: int = LINES) -> tuple[float, int]:
    """Half width of a window and least count of collisions for unit vectors.

    On a line with normal components, two unit vectors of cosine ``limit`` lie
    a normal distance of variance ``2 - 2 * limit`` apart. The width lets
    three in four such pairs collide on a line; the count is the largest that
    the binomial number of collisions reaches with probability ``recall``.
    """
    p = 0.75
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erf(middle / math.sqrt(2)) < p else (low, middle)
    tail, least = 0.0, 0
    while True:
        tail += math.comb(lines, least) * p**least * (1 - p) ** (lines - least)
        if tail > 1 - recall:
            return low * math.sqrt(2 - 2 * limit), least
        least += 1


def prefixes(order: np.ndarray, cells: int = 256) -> np.ndarray:
    """For each line and each of ``cells`` cuts of its order, the candidates before the cut, a bit each."""
    lines, n = order.shape
    out = np.zeros((lines, cells + 1, -(-n // 64)), np.uint64)
    cell = np.arange(n) * cells // n + 1
    for k in range(lines):
        np.bitwise_or.at(out[k], (cell, order[k] >> 6), np.uint64(1) << (order[k] & 63).astype(np.uint64))
        np.bitwise_or.accumulate(out[k], axis=0, out=out[k])
    return out


def counted(inputs: Iterator[np.ndarray]) -> list[np.ndarray]:
    """Binary digits, lowest first, of how many of ``inputs`` have each bit set."""
    levels: list[list[np.ndarray]] = []

    def push(place: int, bits: np.ndarray) -> None:
        while True:
            if place == len(levels):
                levels.append([])
            levels[place].append(bits)
            if len(levels[place]) < 3:
                return
            a, b, c = levels[place]
            odd = a ^ b
            a &= b
            b = odd & c
            a |= b
            odd ^= c
            levels[place] = [odd]
            place, bits = place + 1, a

    for bits in inputs:
        push(0, bits)
    digits, place = [], 0
    while place < len(levels):
        if len(levels[place]) == 2:
            a, b = levels[place]
            levels[place] = [a ^ b]
            push(place + 1, a & b)
        digits.append(levels[place][0] if levels[place] else None)
        place += 1
    return [d if d is not None else np.zeros_like(digits[0]) for d in digits]


def collided(queries: np.ndarray, values: np.ndarray, width: float, least: int, cells: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, candidate) that fall into each other's window on ``least`` lines.

    ``queries`` and ``values`` have a row a vector and a column a line. Each
    line is sorted and cut into cells; the candidates in a window are the
    difference of two stored prefixes, a bit each, and cuts only widen it.
    """
    n, lines = values.shape
    order = np.argsort(values, axis=0).T
    before = prefixes(order, cells)
    ranks = np.take_along_axis(values.T, order, 1)
    # where a cell begins; the last cells of few rows can be empty
    cut_at = [np.append(ranks[k], np.inf)[-(-np.arange(cells) * n // cells)] for k in range(lines)]
    low = np.stack([np.maximum(np.searchsorted(cut_at[k], queries[:, k] - width, "left") - 1, 0) for k in range(lines)])
    high = np.stack([np.searchsorted(cut_at[k], queries[:, k] + width, "right") for k in range(lines)])
    step = max(1, 8192 // before.shape[2])
    for start in range(0, len(queries), step):
        part = slice(start, start + step)
        digits = counted(before[k].take(high[k, part], axis=0) & ~before[k].take(low[k, part], axis=0) for k in range(lines))
        # counts >= least: from the highest digit down, more already or alike so far
        above, alike = np.zeros_like(digits[0]), np.full_like(digits[0], 0xFFFFFFFFFFFFFFFF)
        for place in range(max(len(digits), least.bit_length()) - 1, -1, -1):
            digit = digits[place] if place < len(digits) else np.zeros_like(above)
            if least >> place & 1:
                alike &= digit
            else:
                above |= alike & digit
                alike &= ~digit
        above |= alike
        q, word = np.nonzero(above)
        if len(q):
            bits = np.unpackbits(above[q, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(bits)
            yield q[row] + start, word[row] * 64 + bit


def lines_of(dim: int, lines: int = LINES) -> np.ndarray:
    """Random lines, a column each, the same in every task."""
    return np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, lines))


class Forest:
    """Labels of vertices 0 to n - 1, merged as links come."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0).tolist():
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        to = np.arange(len(self.label))
        for x in parent:
            to[x] = root(x)
        self.label = to[self.label]


def linked(vectors: DataFrame, limit: float, recall: float, block_rows: int, block_bytes: int = 8 << 20) -> DataFrame:
    """What each pair of blocks knows of a vector: ``id, links, root``.

    ``vectors`` has ``id, vector, n``; ``links`` sums ``n`` over the vectors
    linked with ``id`` there, and ``root`` is one it is connected with there.
    Blocks of vectors of one length, of about ``block_rows`` rows and
    ``block_bytes`` at most, meet in pairs, a task each, and a block travels
    once for each block it meets; of the links themselves, however many, only
    sums and a spanning forest leave the task.
    """
    width, least = calibrated(limit, recall)
    kept = vectors.withColumn("dim", F.size("vector"))
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.count("*") * F.col("dim") * 8 / block_bytes)).cast("int")
    kept = kept.join(kept.groupBy("dim").agg(blocks.alias("blocks")), "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        values = matrix(table["vector"], table["dim"][0].as_py())
        held = {"ids": table["id"].to_numpy(), "sizes": table["n"].to_numpy(), "vectors": units(values).astype("<f8")}
        return pa.table({x: table[x].slice(0, 1) for x in ("dim", "blocks", "block")} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in held.items()})

    whole = cut(kept.groupBy("dim", "block").applyInArrow(pack, "dim int, blocks int, block int, ids binary, sizes binary, vectors binary"))
    meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sides = whole.select("*", meets).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "dim", "ids", "sizes", "vectors")

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        ids, sizes = (np.concatenate([np.frombuffer(r[x], np.int64) for r in rows]) for x in ("ids", "sizes"))
        unit = [np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"]) for r in rows]
        spread = lines_of(unit[0].shape[1])
        shift = len(unit[0]) if len(rows) == 2 else 0
        links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for q, c in collided(unit[0] @ spread, unit[-1] @ spread, width, least):
            if not shift:
                once = q < c
                q, c = q[once], c[once]
            for s in range(0, len(q), 1 << 16):
                qs, cs = q[s : s + (1 << 16)], c[s : s + (1 << 16)]
                good = np.einsum("ij,ij->i", unit[0][qs], unit[-1][cs]) >= limit
                a, b = qs[good], cs[good] + shift
                np.add.at(links, a, sizes[b])
                np.add.at(links, b, sizes[a])
                forest.link(a, b)
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "links": links[some], "root": ids[forest.label[some]]})

    return sides.groupBy("dim", "i", "j").applyInArrow(meet, "id long, links long, root long")


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.9, recall: float = 0.9999, block_rows: int = 16384) -> DataFrame:
    """Links and component of every vector.

    Returns one row per row of ``rows``: ``vec_id, n_links, component_id,
    kept``. Vectors that are null, zero or hold null or non-finite components
    link with nothing, nor do rows with a null id, which are never kept; vectors
    link with those of their own length only. Equal vectors are compared once
    and all of them linked. Rows that repeat an id count as one vector. Extra
    columns are ignored; an empty table gives an empty result.
    """
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = given.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    keyed = good.select("vec_id", one_zero(F.col("v")).alias("v")).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256))
    member = cut(keyed.select("vec_id", "key").distinct())
    classes = cut(keyed.groupBy("key").agg(F.min("vec_id").alias("id"), F.first("v").alias("vector")))
    sizes = member.groupBy("key").agg(F.count("*").alias("n"))
    sized = classes.join(sizes, "key")
    found = cut(linked(sized.select("id", "vector", "n"), limit, recall, block_rows))
    far = found.groupBy("id").agg(F.sum("links").alias("far"))
    roots = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = sized.select("key", "id", "n").join(far, "id", "left").join(roots, "id", "left")
    of_class = of_class.select("key", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # a repeated id with several vectors takes the smallest component and all links
    result = member.hint("merge").join(of_class.hint("merge"), "key").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = given.select("vec_id").join(result, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
