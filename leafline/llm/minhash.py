"""Near-duplicate documents by circulant MinHash.

One permutation of the 64-bit shingle hashes scatters a document's shingles,
and a second permutation of the 32-bit numbers, shifted circularly by k steps,
gives signature coordinate k. Coordinates are banded, documents that agree on a
band are candidates, and every link is confirmed on the two full shingle sets.

Documents with one set are one class and only its smallest id is compared.
Documents connected through buckets form a family. A family of bounded size is
settled in one task, which each of its texts reaches once. In larger ones
members are held against a few hubs at first, a hub travelling once for a block
of members; links merge documents into components, and only pairs between
different components of a bucket are left. Those are all compared, in blocks
where many remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafline.llm.hashing import mix, shingle_sets, shingle_sets_of_many, slices
from leafline.llm.runtime import FEW, Tables, connected_components, fresh, narrow

_STRIDE = 0x9E3779B1


def signature(found: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of each set, as rows; an empty set has all ones."""
    n = len(bounds) - 1
    out = np.full((size, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        scattered = (mix(found ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
        at = bounds[full]
        held, shifted = np.empty_like(scattered), np.empty_like(scattered)
        for k in range(size):
            np.subtract(scattered, np.uint32(k * _STRIDE & 0xFFFFFFFF), out=held)
            np.multiply(held, np.uint32(0x85EBCA6B), out=held)
            np.right_shift(held, np.uint32(15), out=shifted)
            np.bitwise_xor(held, shifted, out=held)
            np.multiply(held, np.uint32(0xC2B2AE35), out=held)
            out[k, full] = np.minimum.reduceat(held, at)
    return out.T


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """Per document: ``id``, number of shingles ``n``, 128-bit set key ``s1, s2`` and band hashes ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                found, bounds = shingle_sets(texts, size)
                n, some = np.diff(bounds), np.flatnonzero(np.diff(bounds))
                keys = np.zeros((2, len(n)), np.uint64)
                hashes = np.zeros((len(n), bands), np.uint64)
                if len(some):
                    keys[0, some] = np.add.reduceat(mix(found + np.uint64(11)), bounds[some])
                    keys[1, some] = np.add.reduceat(mix(found ^ np.uint64(0x2545F4914F6CDD1D)), bounds[some])
                    parts = signature(found, bounds, bands * rows).astype(np.uint64).reshape(len(n), bands, rows)
                    hashes += np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        hashes = mix(hashes * np.uint64(0xA24BAED4963EE407) + parts[:, :, r])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, hashes.size + 1, bands, dtype=np.int32), hashes.view(np.int64).ravel()),
                    ],
                    ["id", "n", "s1", "s2", "bands"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>")


def _meets(found: np.ndarray, bounds: np.ndarray, asked: np.ndarray, held: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of ``asked`` with those rows, marked in ``held``, whose sets reach the similarity with its own."""
    n = np.diff(bounds)
    rows = np.flatnonzero(held)
    owner = np.repeat(rows, n[rows])
    inside = found[np.repeat(bounds[rows] - np.cumsum(n[rows]) + n[rows], n[rows]) + np.arange(n[rows].sum())]
    order = np.argsort(inside, kind="stable")
    keys, owner = inside[order], owner[order]
    for x in asked:
        mine = found[bounds[x] : bounds[x + 1]]
        low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
        runs = high - low
        at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        shared = np.bincount(owner[at], minlength=len(n))
        yield x, np.flatnonzero((100 * shared >= percent * (n + n[x] - shared)) & (shared > 0))


def confirmed(pairs: DataFrame, texts: DataFrame, tables: Tables, size: int, percent: int, block_rows: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity, counted exactly.

    ``texts`` has ``id, text``. The partners of one ``a`` are dealt to blocks of
    about ``block_rows``; the text of ``b`` travels once a pair, that of ``a``
    once a block.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
    dealt = tables.put(pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")))
    hubs_of = tables.put(narrow(dealt).select("a", "block").distinct())
    ahead = texts.join(hubs_of, F.col("a") == F.col("id")).select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    after = texts.join(dealt, F.col("b") == F.col("id")).select("a", "block", "b", "text")
    rows = ahead.unionByName(after).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hubs = None, []
        for batch in batches:
            a, block, b = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            hub, b = np.asarray(b.is_null()), b.fill_null(0).to_numpy()
            for start, part in slices(batch.column(3)):
                found, bounds = shingle_sets(part, size)
                n, k = np.diff(bounds), len(part)
                turns = np.flatnonzero((np.diff(a[start : start + k]) != 0) | (np.diff(block[start : start + k]) != 0)) + 1
                good = np.zeros(k, bool)
                for low, high in zip([0, *turns], [*turns, k], strict=True):
                    if (key := (a[start + low], block[start + low])) != now:
                        now, hubs = key, []
                    while low < high and hub[start + low]:
                        hubs.append(found[bounds[low] : bounds[low + 1]].copy())
                        low += 1
                    if low == high:
                        continue
                    asked, ends = found[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
                    for one in hubs:
                        if len(one):
                            same = one[np.minimum(np.searchsorted(one, asked), len(one) - 1)] == asked
                            shared = np.diff(np.concatenate([[0], np.cumsum(same)])[ends])
                            good[low:high] |= (100 * shared >= percent * (n[low:high] + len(one) - shared)) & (shared > 0)
                at = np.flatnonzero(good) + start
                yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _settled(members: DataFrame, size: int, percent: int) -> DataFrame:
    """The component of every member (family, id, text) of whole families, as ``id, component``."""

    def components(table: pa.Table) -> pa.RecordBatch:
        family, ids = table["family"].to_numpy(), table["id"].to_numpy()
        found, bounds = shingle_sets_of_many(table["text"], size)
        label = ids.copy()
        cuts = np.flatnonzero(np.diff(family)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            mine, sets, ends = label[low:high], found[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
            for x, rows in _meets(sets, ends, np.arange(high - low), np.ones(high - low, bool), percent):
                joined = np.unique(np.append(mine[rows], mine[x]))
                if len(joined) > 1:
                    mine[np.isin(mine, joined)] = joined[0]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], ["id", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            family = table["family"].to_numpy()
            whole = int(np.searchsorted(family, family[-1])) if len(family) else 0  # the last family may go on
            if whole:
                yield components(table.slice(0, whole))
            held = table.slice(whole)
        if held is not None and len(held):
            yield components(held)

    return members.select("family", "id", "text").repartition("family").sortWithinPartitions("family").mapInArrow(run, "id long, component long")


def _family_links(members: DataFrame, size: int, percent: int, block_rows: int, block_bytes: int = 32 << 20) -> DataFrame:
    """All links between members (family, id, component, text) of one family and different components.

    A family's members meet in pairs of blocks, a task each, where shared
    shingles are counted through an index of the block; only links leave it.
    """
    blocks = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) / block_bytes))
    counts = members.groupBy("family").agg(blocks.cast("int").alias("blocks"))
    placed = members.join(counts, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sides = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = sides.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "text")

    def meet(table: pa.Table) -> pa.Table:
        ids, component, block = (table[x].to_numpy() for x in ("id", "component", "block"))
        found, bounds = shingle_sets_of_many(table["text"], size)
        first = block == table["i"][0].as_py()
        one = table["i"][0].as_py() == table["j"][0].as_py()
        names, times = np.unique(component, return_counts=True)
        most = names[times.argmax()]  # pairs within it, the bulk, never come up
        a, b = [], []
        # each pair once: rare ones of the first block against all, then the common of the first against rare ones
        rare = component != most
        for asked, held in [(first & rare, first)] if one else [(first & rare, ~first), (~first & rare, first & ~rare)]:
            for x, y in _meets(found, bounds, np.flatnonzero(asked), held, percent):
                y = y[component[y] != component[x]]
                a.append(np.full(len(y), ids[x]))
                b.append(ids[y])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return sides.groupBy("family", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def _open(member: DataFrame, component: DataFrame) -> DataFrame:
    """Members, with their component, of the buckets that still hold two, and each bucket's ``low``, its commonest component."""
    at = member.hint("merge").join(component.hint("merge"), "rep")
    parts = at.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    spread = parts.groupBy("bucket").agg(F.max_by("component", F.struct("k", (-F.col("component")).alias("c"))).alias("low"), F.count("*").alias("parts"))
    return at.hint("merge").join(spread.where("parts > 1").select("bucket", "low").hint("merge"), "bucket")


def _hub_pairs(at: DataFrame, turn: int, hubs: int) -> DataFrame:
    """Each member outside its bucket's commonest component against ``hubs`` members of that, the ones it shares most buckets with."""
    order = F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")
    chosen = at.where("component = low").groupBy("bucket").agg(F.min_by("rep", order).alias("hub"))
    rest = at.where("component <> low").select("bucket", "rep").hint("merge").join(chosen.hint("merge"), "bucket")
    shared = rest.groupBy("rep", "hub").agg(F.count("*").alias("k"))
    best = Window.partitionBy("rep").orderBy(F.desc("k"), "hub")
    return shared.withColumn("r", F.row_number().over(best)).where(F.col("r") <= hubs).select(F.col("hub").alias("a"), F.col("rep").alias("b"))


def _merged(component: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """``component`` with the components merged that ``links`` connect."""
    a, b = component.select(F.col("rep").alias("a"), F.col("component").alias("ca")), component.select(F.col("rep").alias("b"), F.col("component").alias("cb"))
    edges = links.hint("merge").join(a.hint("merge"), "a").hint("merge").join(b.hint("merge"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    roots = connected_components(edges).select(F.col("id").alias("component"), F.col("component").alias("root"))
    return component.hint("merge").join(roots.hint("merge"), "component", "left").select("rep", F.coalesce("root", "component").alias("component")).coalesce(parts)


def _rest(at: DataFrame, texts: DataFrame, tables: Tables, size: int, percent: int, pairs_in_bucket: int, block_rows: int) -> DataFrame:
    """All links that are left between components of one bucket.

    In buckets with up to ``pairs_in_bucket`` pairs left each pair is confirmed
    once. Documents of fuller buckets form families, so that each of them is
    read once a block and not for each bucket it is in.
    """
    parts = at.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    load = parts.groupBy("bucket").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("load"))
    sized = tables.put(at.hint("merge").join(load.hint("merge"), "bucket").select("bucket", "rep", "component", "load"))
    light = sized.where(f"load <= {pairs_in_bucket}")
    other = light.select("bucket", F.col("rep").alias("b"), F.col("component").alias("cb"))
    met = light.hint("merge").join(other.hint("merge"), "bucket").where("rep < b and component <> cb")
    pairs = narrow(tables.put(met.select(F.col("rep").alias("a"), "b").distinct()))
    found = confirmed(pairs, texts, tables, size, percent, block_rows)
    heavy = narrow(tables.put(sized.where(f"load > {pairs_in_bucket}").select("bucket", "rep", "component")))
    if heavy.isEmpty():
        return found
    low = heavy.groupBy("bucket").agg(F.min("rep").alias("low"))
    family = connected_components(heavy.join(low, "bucket").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct())
    family = family.select("id", F.col("component").alias("family"))
    members = heavy.select(F.col("rep").alias("id"), "component").distinct().join(family, "id").join(texts, "id")
    return found.unionByName(_family_links(members.select("family", "id", "component", "text"), size, percent, block_rows))


def _components(classes: DataFrame, docs: DataFrame, tables: Tables, size: int, percent: int, hubs: tuple[int, ...], pairs_in_bucket: int, block_rows: int, block_bytes: int = 32 << 20) -> DataFrame | None:
    """``rep, component`` of the classes that share a bucket with another; ``docs`` has ``id, text``."""
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("low"), F.count("*").alias("k")).where("k > 1")
    stored = tables.put(banded.hint("merge").join(shared.hint("merge"), "bucket").select("bucket", "rep", "n", "low"))
    if stored.isEmpty():
        tables.drop(stored)
        return None
    member = narrow(stored)
    families = connected_components(member.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    families = families.select("id", F.col("component").alias("family"))
    own = member.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n")).hint("merge").join(families.hint("merge"), "id")
    small = (F.count("*") <= block_rows) & (8 * F.sum("n") <= block_bytes)
    sized = own.groupBy("family").agg(small.alias("small"))
    placed = tables.put(own.hint("merge").join(sized.hint("merge"), "family").select("id", "family", "small"))
    texts = docs.hint("merge").join(placed.hint("merge"), "id").groupBy("id", F.xxhash64("text").alias("h"))
    texts = tables.put(texts.agg(F.first("family").alias("family"), F.first("small").alias("small"), F.first("text").alias("text")))
    done = tables.put(_settled(texts.where("small"), size, percent).select(F.col("id").alias("rep"), "component").distinct())
    large = placed.where("not small").select("id")
    rows = large.count()
    if not rows:
        tables.drop(stored, placed, texts)
        return done
    of_large = texts.where("not small").select("id", "text")
    parts = max(1, -(-rows // FEW))
    component = tables.put(large.select(F.col("id").alias("rep"), F.col("id").alias("component")).coalesce(parts))
    held = narrow(tables.put(member.join(large.hint("merge"), F.col("rep") == F.col("id"), "left_semi").select("bucket", "rep")))
    for turn, n in enumerate(hubs):
        pairs = tables.put(_hub_pairs(_open(held, component), turn, n))
        if pairs.isEmpty():
            break
        links = tables.put(confirmed(narrow(pairs), of_large, tables, size, percent, block_rows))
        component = tables.put(_merged(component, narrow(links), parts))
    at = tables.put(_open(held, component))
    if not at.isEmpty():
        links = tables.put(_rest(at, of_large, tables, size, percent, pairs_in_bucket, block_rows))
        component = tables.put(_merged(component, narrow(links), parts))
    out = tables.put(done.unionByName(component))
    tables.drop(*[found for found, _ in tables.made if found is not out and found is not classes])
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 6,
    hubs: tuple[int, ...] = (1, 2, 6),
    pairs_in_bucket: int = 2000,
    block_rows: int = 500,
) -> DataFrame:
    """The component of every document under the links of ``percent`` similarity.

    Returns one row per row of ``docs``: ``doc_id, n_shingles, component_id,
    kept, set_key``. 32 bands of 6 rows find a pair of similarity 0.8 with
    probability 0.99994, and more similar pairs more surely. ``block_rows``
    bounds a family that one task settles and the blocks of larger ones.

    Null or empty texts and texts without words have an empty set and link with
    nothing. Repeated rows and equal sets are linked; rows that repeat an id
    with another text link by either. A null id stays null: its
    component is the smallest non-null id it is linked with, null if none, and
    it is never kept. Columns beside the two named are ignored. An empty table
    gives an empty result.
    """
    tables = Tables(docs.sparkSession)
    sketch = tables.put(sketches(docs, id_col, text_col, size, bands, rows))
    first = sketch.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = tables.put(first.where("rep is not null"))
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = sketch.select("id", "n", "s1", "s2")
    label = classes.select("s1", "s2", "n", "rep")
    component = _components(classes, given, Tables(docs.sparkSession), size, percent, hubs, pairs_in_bucket, block_rows)
    label = label.join(component, "rep", "left") if component is not None else label.withColumn("component", F.col("rep"))
    label = label.select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    full = keyed.where("n > 0").hint("merge").join(label.hint("merge"), ["s1", "s2", "n"], "left")
    out = full.unionByName(keyed.where("n = 0").withColumn("component", F.lit(None).cast("long")))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
        F.when(F.col("n") > 0, F.concat_ws("-", F.hex("s1"), F.hex("s2"))).alias("set_key"),
    )


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each component, whole and once; rows without an id stay.

    Rows that repeat an id give one row. Texts without words link with nothing and
    stay; an empty table gives an empty result; other columns are as they were.
    """
    id_col, name = settings.get("id_col", "doc_id"), fresh(docs.columns, "_kept")
    found = near_duplicates(docs, **settings).where("kept").select(F.col("doc_id").alias(name)).distinct()
    ids = docs.where(F.col(id_col).isNotNull()).join(found, F.col(id_col) == F.col(name), "left_semi")
    return ids.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
