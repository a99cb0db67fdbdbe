"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
turns a unit vector; its hash is the nearest signed axis. A table's code joins
the hashes of two rotations. Every row lies in one bucket of each table, a query
looks into the buckets of each table that it comes nearest to, and an equi-join
on table and code collects the candidates, which are ranked by exact distance.

Queries ask in two rounds. A few buckets give each a distance within which its
nearest lie for certain; in the second round rows that meet a query in a bucket
are candidates only if the signs of both vectors along the table's directions
allow so small a distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm.runtime import Tables
from leafline.llm.vectors import by_dimension, matrix, one_zero, units, usable

#: Axes of one rotation that a query's probes are made of, at most.
AXES = 128
#: Signs of a vector that each table keeps, a multiple of 64.
SIGNS = 192
#: Standard deviations by which the signs of a pair may differ beyond what its distance lets expect.
SLACK = 1.0
#: Rows that the first round is to find a query, for each of the ``k`` asked for.
FIRST = 40
#: Rows of candidates that a task keeps before it hands some over.
HELD_ROWS = 1_000_000


def rotated(unit: np.ndarray, table: int) -> np.ndarray:
    """Rows of ``unit`` under pseudo-rotation ``table``, padded to a power of two."""
    dim = 1 << max(0, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), dim))
    x[:, : unit.shape[1]] = unit
    signs = np.random.Generator(np.random.PCG64(1000 + table)).choice([-1.0, 1.0], (3, dim))
    for s in signs:
        x *= s
        half = 1
        while half < dim:
            y = x.reshape(len(x), -1, 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), dim)
            half *= 2
        x /= np.sqrt(dim)
    return x


def axis(turned: np.ndarray) -> np.ndarray:
    """The nearest signed axis: its number, plus the dimension if negative."""
    at = np.abs(turned).argmax(1)
    return at + turned.shape[1] * (turned[np.arange(len(turned)), at] < 0)


def code(unit: np.ndarray, table: int) -> np.ndarray:
    """The bucket of each row in ``table``."""
    first, second = rotated(unit, 2 * table), rotated(unit, 2 * table + 1)
    return axis(first) * (2 * first.shape[1]) + axis(second)


def probed(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` buckets of ``table`` that each row comes nearest to, those first by how far both axes stand back."""
    sides = []
    for turned in (rotated(unit, 2 * table), rotated(unit, 2 * table + 1)):
        signed = np.concatenate([turned, -turned], 1)
        axes = np.argsort(-signed, 1, kind="stable")[:, :AXES]
        behind = signed.max(1, keepdims=True) - np.take_along_axis(signed, axes, 1)
        sides.append((axes, behind**2))
    (a, lost_a), (b, lost_b) = sides
    lost = (lost_a[:, :, None] + lost_b[:, None, :]).reshape(len(unit), -1)
    most = min(probes, lost.shape[1])
    best = np.argpartition(lost, most - 1, 1)[:, :most]
    width = 2 * (1 << max(0, (unit.shape[1] - 1).bit_length()))
    return np.take_along_axis(a, best // b.shape[1], 1) * width + np.take_along_axis(b, best % b.shape[1], 1)


def probes_for(rows: int, dim: int, tables: int) -> int:
    """Probes a table, so that a query meets a share of the rows that falls as rows grow.

    The share, 3.7 times the power -0.32 of ``rows``, keeps recall over 0.9 even for
    vectors that lie as if at random: the more rows, the nearer the tenth is.
    """
    codes = (2 * (1 << max(0, (dim - 1).bit_length()))) ** 2
    share = min(1.0, 3.7 * max(rows, 1) ** -0.32)
    return max(1, round(share * codes / tables))


def probes_first(rows: int, dim: int, tables: int, wanted: int) -> int:
    """Probes a table with which a query meets about ``wanted`` rows, or more where vectors lie close."""
    codes = (2 * (1 << max(0, (dim - 1).bit_length()))) ** 2
    return min(codes, max(1, -(-wanted * codes // (max(rows, 1) * tables))))


@cache
def directions(dim: int, table: int) -> np.ndarray:
    """``SIGNS`` directions of ``table`` as columns, at right angles in blocks of as many as ``dim`` has room for."""
    rng = np.random.Generator(np.random.PCG64([2000 + table, dim]))
    blocks = [np.linalg.qr(rng.standard_normal((dim, min(dim, SIGNS))))[0] for _ in range(-(-SIGNS // dim))]
    return np.concatenate(blocks, 1)[:, :SIGNS]


def signs(unit: np.ndarray, table: int) -> np.ndarray:
    """On which side of each direction of ``table`` a row lies, 64 of them a number."""
    return np.packbits(unit @ directions(unit.shape[1], table) > 0, axis=1).view(np.int64)


def lengths(values: np.ndarray) -> np.ndarray:
    """Lengths of rows; components of any size neither overflow nor vanish when squared."""
    most = np.abs(values).max(1)
    scaled = values / most[:, None]
    return most * np.sqrt(np.einsum("ij,ij->i", scaled, scaled))


WORDS = [f"s{i}" for i in range(SIGNS // 64)]
_PLACE = "dim int, t int, code long, length double, " + ", ".join(f"{x} long" for x in WORDS)


def in_buckets(index: DataFrame, tables: int) -> DataFrame:
    """The bucket of each row of ``index`` (row, v) in each table, with its length and signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, values in by_dimension(batch.column(1)):
                unit, long, ids = units(values), lengths(values), batch.column(0).to_numpy()[at]
                for t in range(tables):
                    sides = signs(unit, t)
                    columns = [ids, np.full(len(ids), dim, np.int32), np.full(len(ids), t, np.int32), code(unit, t), long, *sides.T]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["row", "dim", "t", "code", "length", *WORDS])

    return index.mapInArrow(run, f"row long, {_PLACE}")


def asking(asked: DataFrame, n: dict[int, int], tables: int, rule: Callable[[int, int, int], int], query_rows: int) -> DataFrame:
    """The buckets that each query of ``asked`` (id, v, away) looks into, ``rule(rows, dim, tables)`` of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, values in by_dimension(batch.column(1)):
                unit, long = units(values), lengths(values)
                ids, away = batch.column(0).to_numpy()[at], batch.column(2).take(pa.array(at))
                most = rule(n.get(dim, 1), dim, tables)
                for t in range(tables):
                    sides = signs(unit, t)
                    for low in range(0, len(ids), query_rows):
                        found = probed(unit[low : low + query_rows], t, most)
                        each = np.repeat(np.arange(low, low + len(found)), found.shape[1])
                        columns = [ids[each], np.full(len(each), dim, np.int32), np.full(len(each), t, np.int32), found.ravel(), long[each], *sides[each].T]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), away.take(pa.array(each))], ["query", "dim", "t", "code", "length", *WORDS, "away"])

    return asked.select("id", "v", "away").mapInArrow(run, f"query long, {_PLACE}, away double")


def allowed(slack: float = SLACK) -> Column:
    """Whether a query ``q`` and a row ``r`` in its bucket may be no farther than ``q.away`` apart, by their lengths and signs.

    Two vectors of these lengths and so far apart have a known angle, and each sign
    differs with the probability of the angle over pi. Pairs whose signs differ in
    more than the expected number and ``slack`` standard deviations are not worth a
    look in this table; each other table decides with signs of its own. Without
    ``away``, or where its angle is no number, all are.
    """
    ratio, far = F.col("r.length") / F.col("q.length"), F.col("q.away") / F.col("q.length")
    cosine = F.try_divide(F.lit(1.0) - far * far, ratio) / 2 + ratio / 2
    differs = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) / np.pi
    most = SIGNS * differs + slack * F.sqrt(SIGNS * differs * (1 - differs)) + 1
    apart = sum((F.bit_count(F.col(f"q.{x}").bitwiseXOR(F.col(f"r.{x}"))) for x in WORDS), F.lit(0))
    return F.coalesce(F.isnan(cosine) | (apart <= most), F.lit(True))


def meeting(buckets: DataFrame, probe: DataFrame, only: Column | None = None) -> DataFrame:
    """Distinct pairs (query, row) that meet in a bucket, those for which ``only`` holds."""
    same = (F.col("q.dim") == F.col("r.dim")) & (F.col("q.t") == F.col("r.t")) & (F.col("q.code") == F.col("r.code"))
    both = probe.alias("q").hint("merge").join(buckets.alias("r").hint("merge"), same if only is None else same & only)
    return both.select("q.query", "r.row").distinct()


def candidates(index: DataFrame, asked: DataFrame, n: dict[int, int], tables: int, probes: int | None, query_rows: int) -> DataFrame:
    """Distinct pairs (query, row) that meet in a bucket, of ``index`` (row, v) with ``n`` rows a dimension, and ``asked`` (id, v)."""
    asked = asked.withColumn("away", F.lit(None).cast("double"))
    return meeting(in_buckets(index, tables), asking(asked, n, tables, lambda *x: probes or probes_for(*x), query_rows))


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = 20,
    probes: int | None = None,
    block_rows: int = 8192,
    query_rows: int = 256,
    query_bytes: int = 16 << 20,
) -> DataFrame:
    """The ``k`` nearest rows found for each query, by Euclidean distance.

    Returns ``query_id, rank, vec_id, score``: rank from 1, nearest first, ties
    to the smaller id; ``score`` is the distance on the original vectors in
    double precision. A query's own id is no candidate. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do null ids;
    rows that repeat an id count once, with their smallest vector, and vectors
    meet those of their own length only. Equal vectors are one entry of the
    index. ``probes`` buckets of each table are searched, by default
    ``probes_for`` the table. A first round asks a quarter of the tables for about
    ``FIRST * k`` rows a query; the farthest of the ``k + 1`` nearest it finds bounds
    what the second round, in all tables, looks at (see ``allowed``). A query whose buckets hold fewer than ``k`` others
    is compared with all rows, in blocks of ``block_rows``. ``query_rows`` are probed at a
    time. Query vectors go to all tasks if together they hold at most ``query_bytes``, and are joined beyond
    that. Extra columns are ignored; empty tables give an empty result.
    """
    store = Tables(rows.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        held = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        held = held.where(usable(F.col("v")) & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
        return held.select("id", one_zero(F.col("v")).alias("v"))

    # of equal vectors, the first k + 1 ids are all that a query can need
    keyed = clean(rows).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1)))
    first = keyed.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    index = store.put(first.groupBy("h1", "h2").agg(F.min("id").alias("row"), F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = store.put(clean(queries))
    n = {r["d"]: r["n"] for r in index.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a dimension

    held = asked.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0
    buckets, few = store.put(in_buckets(index.select("row", "v"), tables)), max(1, tables // 4)
    ask = asking(asked.withColumn("away", F.lit(None).cast("double")), n, few, lambda *x: min(probes or probes_for(*x), probes_first(*x, FIRST * k)), query_rows)
    early = store.put(_ranked(meeting(buckets.where(F.col("t") < few), ask), index, asked, k, held <= query_bytes))
    # nothing farther than the first so many can be among the nearest
    bound = early.groupBy(F.col("query").alias("id")).agg(F.max("score").alias("away"), F.sum("others").alias("others")).where(F.col("others") >= k)
    ask = asking(asked.join(bound.drop("others"), "id", "left"), n, tables, lambda *x: probes or probes_for(*x), query_rows)
    late = _ranked(meeting(buckets, ask, allowed()), index, asked, k, held <= query_bytes)
    some = store.put(early.unionByName(late).dropDuplicates(["query", "row"]))
    # queries whose buckets hold too few
    enough = some.groupBy(F.col("query").alias("id")).agg(F.sum("others").alias("others")).where(F.col("others") >= k)
    short = store.put(asked.join(enough, "id", "left_anti"))
    if not short.isEmpty():
        blocks = max(1, -(-sum(n.values()) // block_rows))
        everywhere = short.select(F.col("id").alias("query"), F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        whole = index.select("row", F.size("v").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
        more = _ranked(everywhere.join(whole, ["dim", "block"]).select("query", "row"), index, short, k, held <= query_bytes)
        some = some.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    near = some.select("query", "score", F.explode("ids").alias("vec_id")).where("query <> vec_id")
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; differences of any size neither overflow nor vanish when squared."""
    apart = np.abs(a - b)
    most = apart.max(1)
    scale = np.where((most > 0) & ((most > 1e100) | (most < 1e-100)), most, 1.0)
    apart /= scale[:, None]
    return np.sqrt((apart * apart).sum(1)) * scale


def _ranked(pairs: DataFrame, index: DataFrame, asked: DataFrame, k: int, held: bool) -> DataFrame:
    """The nearest ``k + 1`` entries of each query among ``pairs`` (query, row): ``query, score, ids, others``."""
    met = pairs.hint("merge").join(index.select("row", "v").hint("merge"), "row").select("query", "row", "v")
    if held:
        wanted = pairs.sparkSession.sparkContext.broadcast({r["id"]: np.array(r["v"]) for r in asked.collect()})  # its size was checked
    else:
        met = met.hint("merge").join(asked.select(F.col("id").alias("query"), F.col("v").alias("q")).hint("merge"), "query").select("query", "row", "v", "q")

    def nearest(query: np.ndarray, row: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, ...]:
        """The first ``k + 1`` of each query: nothing farther can be among the first ``k + 1`` of all."""
        order = np.lexsort((row, away, query))
        query, row, away = query[order], row[order], away[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = np.flatnonzero(nth <= k)
        return query[keep], row[keep], away[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task has found so far, up to so many rows that memory stays small however many queries there are
        found: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            query, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            away = np.zeros(len(query))
            for dim, at, values in by_dimension(batch.column(2)):
                if held:
                    names, where = np.unique(query[at], return_inverse=True)
                    sought = np.stack([wanted.value[x] for x in names.tolist()])[where]
                else:
                    sought = matrix(batch.column(3).take(pa.array(at)), dim)
                away[at] = _distances(values, sought)
            if len(query):
                found.append(nearest(query, row, away))
                size += len(found[-1][0])
            if size > HELD_ROWS:
                found = [nearest(*map(np.concatenate, zip(*found, strict=True)))]
                size = len(found[0][0])
                if 2 * size > HELD_ROWS:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found[0])], ["query", "row", "score"])
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([*map(pa.array, nearest(*map(np.concatenate, zip(*found, strict=True))))], ["query", "row", "score"])

    near = met.mapInArrow(run, "query long, row long, score double")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "row"))).where(F.col("r") <= k + 1)
    found = near.join(index.select("row", "ids"), "row").select("query", "row", "score", "ids")
    return found.withColumn("others", F.size(F.array_remove("ids", F.col("query"))))
