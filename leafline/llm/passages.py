"""Passages that documents repeat from one another, found to the byte.

A stretch of ``length`` bytes is a window, and its anchor is the gram in it with
the least hash: equal windows have equal anchors, wherever they are.
Consecutive windows with one anchor form a strip. A window holds half of what it
has besides its anchor before it or behind it; the anchor with that context is
the window's key. Documents travel in chunks of some megabytes, and each step is
a shuffle of chunks' parts:

1. Keys that more than one document has are found from five bytes a key and
   chunk.
2. The windows with such keys, as strips, each distinct text of a chunk once, go
   to their anchor's bucket. There hashes of windows tell which documents a strip
   may repeat; a run-length index is built of the strips of each such document, and
   the strips that may repeat it are streamed against it, each once a document.
   A window whose match is as long as a window repeats an earlier document.
   Where a hash was of another text, the anchor's strips are halved by document,
   the earlier halves indexed and the later ones streamed, until no half has two
   documents. Strips alike are one there, that of the smallest document with
   it, and repeated whole in all others.
3. Answers return to the chunks, which cover the windows and cut them out.

A key in very many chunks is split by the windows themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.llm.runindex import RunIndex, spread
from leafline.llm.runtime import Tables, short_batches

SHORT = 40  # bits of a hash within its bucket; a chance collision only adds work
MOST = 64  # windows of a strip at most, a bit each
SEGMENT = 1 << 17  # bytes hashed at a time, so that arrays stay in the processor's cache


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two 64-bit numbers, element by element."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def doubled_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, a hash of so many bytes from each place, from hashes of halves."""
    out, h, have = {}, data.astype(np.uint64) + np.uint64(1), 1
    for size in sorted(sizes):
        while have * 2 <= size:
            h, have = mixed(h[:-have], h[have:]), have * 2
        n = len(data) - size + 1
        out[size] = h[:n] if have == size else mixed(h[:n], h[size - have : size - have + n])
    return [out[x] for x in sizes]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the next ``width`` values from each place."""
    m, have = values, 1
    while have * 2 <= width:
        m, have = np.minimum(m[:-have], m[have:]), have * 2
    n = len(values) - width + 1
    return m if have == width else np.minimum(m[:n], m[width - have : width - have + n])


def gram_size(length: int) -> int:
    """Bytes of an anchor: three eighths of a window, so that at 50 one place in 17 is an anchor."""
    return max(1, length * 3 // 8)


def context_size(length: int) -> int:
    """Bytes of context in a key: a window has so many before its anchor, or else behind it."""
    return (length - gram_size(length)) // 2


class Strips:
    """Strips as arrays: ``anchor, start`` (first window), ``size`` (windows), ``place`` (of the anchor), ``before, behind`` (keys of its windows with the context before the anchor, and of the others)."""

    def __init__(self, data: np.ndarray, owner: np.ndarray, length: int):
        """``owner`` is a document's number for each byte, -1 for none."""
        gram, context, n = gram_size(length), context_size(length), len(data) - length + 1
        found = [np.zeros(0, np.int64)] * 3
        hashes = [np.zeros(0, np.uint64)] * 3
        low = np.uint64((1 << SEGMENT.bit_length()) - 1)
        for a in range(0, max(0, n), SEGMENT):
            z = min(n, a + SEGMENT)
            grams, contexts = doubled_hashes(data[a : z + length - 1], gram, gram + context)
            place = (least(grams & ~low | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
            own = owner[a:z]
            whole = (own == owner[a + length - 1 : z + length - 1]) & (own >= 0)
            new = np.ones(z - a, bool)
            new[1:] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1])
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, z - a))
            at, size = at[whole[at]], size[whole[at]]
            place = place[at]
            found = [np.concatenate(x) for x in zip(found, (at + a, size, place + a), strict=True)]
            keys = contexts[np.maximum(place - context, 0)] ^ np.uint64(1), contexts[np.minimum(place, len(contexts) - 1)]
            hashes = [np.concatenate(x) for x in zip(hashes, (grams[place], *keys), strict=True)]
        self.start, self.size, self.place = found
        self.anchor, self.before, self.behind = hashes
        if (self.size > MOST).any():
            parts = -(-self.size // MOST)
            of = np.repeat(np.arange(len(parts)), parts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = self.size[of]
            for name, value in vars(self).items():
                setattr(self, name, value[of])
            self.start, self.size = self.start + nth * MOST, np.minimum(MOST, size - nth * MOST)
        #: Windows that begin up to here have the context before the anchor.
        self.turn = np.clip(self.place - context_size(length) + 1, self.start, self.start + self.size)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys that occur, and the first window with each."""
        one, two = self.turn > self.start, self.turn < self.start + self.size
        return np.concatenate([self.before[one], self.behind[two]]), np.concatenate([self.start[one], self.start[two]])


def located(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's bucket, and its short form there."""
    return ((hashes >> np.uint64(SHORT)) % np.uint64(buckets)).astype(np.int64), hashes & np.uint64((1 << SHORT) - 1)


def packed(short: np.ndarray) -> bytes:
    """Five bytes a number."""
    return np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, each made when it is reached."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class Chunk:
    """Some documents' bytes in a row, with the id that each byte's document has."""

    def __init__(self, data: bytes, n_bytes: int, ids: list, sizes: list):
        self.bytes = pa.decompress(data, decompressed_size=n_bytes, codec="zstd", asbytes=True) if n_bytes else b""
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.known = np.array([x is not None for x in ids], bool)
        self.ids = np.array([x or 0 for x in ids], np.int64)
        number = np.where(self.known, np.arange(len(ids)), -1)
        self.owner = np.repeat(number.astype(np.int32), self.sizes)


def chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Documents together in rows ``chunk, n_bytes, data`` (compressed), ``ids, sizes`` of about ``chunk_bytes`` each; a longer document has a row to itself."""
    schema = "chunk long, n_bytes long, data binary, ids array<long>, sizes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, texts, ids, total = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            joined = b"".join(texts)
            data = pa.compress(joined, codec="zstd", asbytes=True) if joined else b""
            return pa.RecordBatch.from_pydict({"chunk": [number], "n_bytes": [len(joined)], "data": [data], "ids": [ids], "sizes": [[len(x) for x in texts]]}, schema=arrow)

        arrow = pa.schema([("chunk", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or b""
                if texts and total + len(text) > chunk_bytes:
                    yield row()
                    number, texts, ids, total = number + 1, [], [], 0
                texts.append(text)
                ids.append(key)
                total += len(text)
        if texts:
            yield row()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def keys(staged: DataFrame, length: int, buckets: int) -> DataFrame:
    """Rows ``bucket, chunk, keys``: a chunk's keys once, or twice where more than one of its documents has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                chunk = Chunk(r["data"], r["n_bytes"], r["ids"], r["sizes"])
                key, start = Strips(chunk.data, chunk.owner, length).keys()
                doc = chunk.ids[chunk.owner[start]]
                by = np.argsort(key, kind="stable")
                key, doc = key[by], doc[by]
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                if not len(at):
                    continue
                several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                bucket, short = located(np.repeat(key[at], 1 + several), buckets)
                by = np.argsort(bucket, kind="stable")
                bucket, short = bucket[by], short[by]
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                blobs = [packed(x) for x in np.split(short, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(np.full(len(edges), r["chunk"])), pa.array(blobs, pa.binary())], ["bucket", "chunk", "keys"])

    return staged.select("chunk", "n_bytes", "data", "ids", "sizes").mapInArrow(run, "bucket int, chunk long, keys binary")


def shared_keys(found: DataFrame, most_chunks: int) -> DataFrame:
    """Rows ``chunk, bucket, shared, wide``: its keys that another document has too, in ``wide`` those in more than ``most_chunks`` chunks."""

    def run(rows: pa.Table) -> pa.Table:
        each = [unpacked(x.as_py()) for x in rows["keys"]]
        values, counts = np.unique(np.concatenate(each), return_counts=True)
        several, wide = values[counts > 1], values[counts > 2 * most_chunks]
        out = {"chunk": [], "bucket": [], "shared": [], "wide": []}
        for x, chunk, bucket in zip(each, rows["chunk"].to_pylist(), rows["bucket"].to_pylist(), strict=True):
            mine = np.unique(x[held(several, x)])
            if len(mine):
                far = held(wide, mine)
                for name, value in (("chunk", chunk), ("bucket", bucket), ("shared", packed(mine[~far])), ("wide", packed(mine[far]))):
                    out[name].append(value)
        return pa.table([pa.array(out["chunk"], pa.int64()), pa.array(out["bucket"], pa.int32()), pa.array(out["shared"], pa.binary()), pa.array(out["wide"], pa.binary())], list(out))

    return found.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, shared binary, wide binary")


def held(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def candidates(chunk: Chunk, shared: list, length: int, buckets: int) -> dict:
    """The chunk's windows with shared keys in strips, as distinct texts in order of bucket, and where each occurs.

    Returns arrays ``bucket, key`` (the anchor there), ``texts`` (a list), ``one``
    (the smallest id), and per occurrence ``of`` (its text), ``start, size, id``.
    """

    def whole(field: str) -> np.ndarray:
        return np.sort(np.concatenate([(np.uint64(x["bucket"]) << np.uint64(SHORT)) | unpacked(x[field]) for x in shared]))

    def located_whole(hashes: np.ndarray) -> np.ndarray:
        bucket, short = located(hashes, buckets)
        return (bucket.astype(np.uint64) << np.uint64(SHORT)) | short

    all_ = Strips(chunk.data, chunk.owner, length)
    near, wide = whole("shared"), whole("wide")
    before, behind = located_whole(all_.before), located_whole(all_.behind)
    end = all_.start + all_.size
    one, two = held(near, before) & (all_.turn > all_.start), held(near, behind) & (all_.turn < end)
    start = np.where(one, all_.start, all_.turn)
    size = np.where(two, end, all_.turn) - start
    start, size, anchor = start[one | two], size[one | two], all_.anchor[one | two]
    far_one, far_two = held(wide, before) & (all_.turn > all_.start), held(wide, behind) & (all_.turn < end)
    start_w = np.concatenate([spread(all_.start[far_one], (all_.turn - all_.start)[far_one]), spread(all_.turn[far_two], (end - all_.turn)[far_two])])
    if len(start_w):  # their hashes are their anchors
        hashes = np.full(len(start_w), np.uint64(length))
        for t in range(length):
            hashes = mixed(hashes, chunk.data[start_w + t].astype(np.uint64))
        start, size, anchor = np.concatenate([start, start_w]), np.concatenate([size, np.ones(len(start_w), np.int64)]), np.concatenate([anchor, hashes])
    bucket, key = located(anchor, buckets)
    by = np.argsort(bucket, kind="stable")
    start, size, bucket, key = start[by], size[by], bucket[by], key[by]
    known: dict[bytes, int] = {}
    of = np.empty(len(start), np.int64)
    data = chunk.bytes
    for i, (a, z) in enumerate(zip(start.tolist(), (start + size + length - 1).tolist(), strict=True)):
        of[i] = known.setdefault(data[a:z], len(known))
    first = np.unique(of, return_index=True)[1]
    ids = chunk.ids[chunk.owner[start]]
    one = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(one, of, ids)
    return {"bucket": bucket[first], "key": key[first], "texts": list(known), "one": one, "of": of, "start": start, "size": size, "id": ids}


def asked(joined: DataFrame, length: int, buckets: int) -> DataFrame:
    """Rows ``bucket, chunk`` with the chunk's distinct strips of that bucket: ``keys, ones, sizes, texts``."""
    names = ["bucket", "chunk", "keys", "ones", "sizes", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                found = candidates(Chunk(r["data"], r["n_bytes"], r["ids"], r["sizes"]), r["shared"], length, buckets)
                if not found["texts"]:
                    continue
                edges = np.flatnonzero(np.append(True, np.diff(found["bucket"]) != 0))
                rows = []
                for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(found["bucket"])], strict=True):
                    texts = found["texts"][a:z]
                    rows.append((packed(found["key"][a:z]), found["one"][a:z].tobytes(), np.array([len(x) for x in texts], np.uint32).tobytes(), b"".join(texts)))
                yield pa.RecordBatch.from_arrays([pa.array(found["bucket"][edges].astype(np.int32)), pa.array(np.full(len(edges), r["chunk"])), *[pa.array(x, pa.binary()) for x in zip(*rows, strict=True)]], names)

    return joined.mapInArrow(run, "bucket int, chunk long, keys binary, ones binary, sizes binary, texts binary")


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the window from each place on, some segments at a time."""
    n = len(data) - length + 1
    return np.concatenate([doubled_hashes(data[a : min(n, a + SEGMENT) + length - 1], length)[0] for a in range(0, n, SEGMENT)])


def spans_of(strips: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of windows in order of their strips, each run of one strip: the strip, its first window and how many lie from there to its last."""
    at = np.flatnonzero(np.append(True, strips[1:] != strips[:-1])[: len(strips)])
    return strips[at], offsets[at], np.append(offsets[at[1:] - 1], offsets[-1:]) - offsets[at] + 1


def repeated_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Per strip, the bits of its windows that also lie in a strip of the same group with a smaller id.

    A window's hash tells the smallest document of its group that may hold it. That
    document's strips are indexed, as far as such windows reach, and each
    other strip is streamed against those of the documents it may repeat. A
    window that none of them holds, though its hash is there, has its group done by halves.
    """
    bits = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return bits
    many = sizes - length + 1
    text = data[spread(starts, sizes)]
    strip, offset = np.repeat(np.arange(len(starts)), many), spread(np.zeros(len(starts), np.int64), many)
    key = mixed(window_hashes(text, length)[spread(np.cumsum(sizes) - sizes, many)], groups.astype(np.uint64)[strip])
    by = np.argsort(key, kind="stable")
    key = key[by]
    edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(edges, len(by)))
    by, count = by[np.repeat(count > 1, count)], count[count > 1]
    if not len(by):
        return bits
    own = ids[strip[by]]
    edges = np.cumsum(count) - count
    least, most = np.minimum.reduceat(own, edges), np.maximum.reduceat(own, edges)
    source, several = np.repeat(least, count), np.repeat(least != most, count)
    first, late = np.sort(by[several & (own == source)]), own > source
    late, source = by[late], source[late]
    if not len(late):
        return bits
    here, begin, wide = spans_of(strip[first], offset[first])
    at = np.lexsort((late, source, strip[late]))
    late, source = late[at], source[at]
    # a strip is asked for once for each document that it may repeat
    asks = np.cumsum(np.append(True, (strip[late[1:]] != strip[late[:-1]]) | (source[1:] != source[:-1]))) - 1
    nth, ask_begin, ask_wide = spans_of(asks, offset[late])
    edges = np.searchsorted(asks, nth)
    ask, meant = strip[late[edges]], source[edges]
    group, doc = np.concatenate([groups[here], groups[ask]]), np.concatenate([ids[here], meant])
    at = np.lexsort((doc, group))
    number = np.empty(len(at), np.int64)
    number[at] = np.cumsum(np.append(False, (np.diff(group[at]) != 0) | (np.diff(doc[at]) != 0)))
    index = RunIndex(data, starts[here] + begin, wide + length - 1, number[: len(here)])
    ask_sizes = ask_wide + length - 1
    found = index.statistics(data, starts[ask] + ask_begin, ask_sizes, number[len(here) :])
    hits = np.flatnonzero(found >= length)
    of = np.repeat(np.arange(len(ask)), ask_sizes)[hits]
    place = hits - (np.cumsum(ask_sizes) - ask_sizes)[of] + ask_begin[of]
    np.bitwise_or.at(bits, ask[of], np.uint64(1) << place.astype(np.uint64))
    missed = (bits[strip[late]] >> offset[late].astype(np.uint64)) & np.uint64(1) == 0
    if missed.any():
        again = np.flatnonzero(np.isin(groups, groups[strip[late[missed]]]))
        bits[again] = halved_windows(data, starts[again], sizes[again], groups[again], ids[again], length)
    return bits


def halved_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, groups: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """What ``repeated_windows`` gives, without hashes.

    Groups are halved by id, the later halves streamed against an index of the
    earlier ones, and both halved again; strips found whole need not go on, for
    an earlier one answers for all that they hold.
    """
    bits = np.zeros(len(starts), np.uint64)
    full = all_windows(sizes, length)
    at = np.lexsort((ids, groups))
    part = np.zeros(len(starts), np.int64)  # which of a group's halves of halves
    while len(at):
        new_part = np.ones(len(at), bool)
        new_part[1:] = (np.diff(groups[at]) != 0) | (np.diff(part[at]) != 0)
        new_id = new_part.copy()
        new_id[1:] |= np.diff(ids[at]) != 0
        nth_part = np.cumsum(new_part) - 1
        rank = np.cumsum(new_id)
        rank -= rank[np.flatnonzero(new_part)][nth_part]  # of the document in its part
        many = np.maximum.reduceat(rank, np.flatnonzero(new_part))[nth_part] + 1
        on = many > 1
        at, late = at[on], (rank >= (many + 1) // 2)[on]
        if not len(at):
            break
        early_at, late_at = at[~late], at[late]
        index = RunIndex(data, starts[early_at], sizes[early_at], part[early_at])
        found = index.statistics(data, starts[late_at], sizes[late_at], part[late_at])
        hits = np.flatnonzero(found >= length)
        of = np.repeat(np.arange(len(late_at)), sizes[late_at])[hits]
        offset = hits - (np.cumsum(sizes[late_at]) - sizes[late_at])[of]
        np.bitwise_or.at(bits, late_at[of], np.uint64(1) << offset.astype(np.uint64))
        part[early_at] *= 2
        part[late_at] = part[late_at] * 2 + 1
        at = np.concatenate([early_at, late_at[bits[late_at] != full[late_at]]])
        at = at[np.lexsort((ids[at], part[at], groups[at]))]
    return bits


def all_windows(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bits of all windows of strips of these sizes."""
    return ~np.uint64(0) >> (MOST - (sizes - length + 1)).astype(np.uint64)


def answers(wanted: DataFrame, length: int, slice_bytes: int) -> DataFrame:
    """Rows ``chunk, bucket, repeats``: per strip asked about, the bits of the windows that its first document there repeats."""

    def run(rows: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        of, keys, ones = [], [], []
        for sizes, texts in zip(rows["sizes"], rows["texts"], strict=True):
            texts, a, mine = texts.as_py(), 0, []
            for z in np.cumsum(np.frombuffer(sizes.as_py(), np.uint32).astype(np.int64)).tolist():
                mine.append(known.setdefault(texts[a:z], len(known)))
                a = z
            of.append(np.array(mine, np.int64))
        for key, one in zip(rows["keys"], rows["ones"], strict=True):
            keys.append(unpacked(key.as_py()))
            ones.append(np.frombuffer(one.as_py(), np.int64))
        size = np.array([len(x) for x in known], np.int64)
        data = np.frombuffer(b"".join(known), np.uint8)
        del known
        start = np.cumsum(size) - size
        every = np.concatenate(of)
        key = np.zeros(len(size), np.int64)
        key[every] = np.concatenate(keys).view(np.int64)
        head = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(head, every, np.concatenate(ones))
        bits = np.zeros(len(size), np.uint64)
        by = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(key[by]) != 0))
        before = np.append(0, np.cumsum(size[by]))
        a = 0
        while a < len(by):  # whole anchors, some megabytes at a time
            n = int(np.searchsorted(edges, np.searchsorted(before, before[a] + slice_bytes)))
            z = int(edges[n]) if n < len(edges) else len(by)
            here = by[a:z]
            bits[here] = repeated_windows(data, start[here], size[here], key[here], head[here], length)
            a = z
        full = all_windows(size, length)
        blobs = [np.where(one > head[mine], full[mine], bits[mine]).tobytes() for mine, one in zip(of, ones, strict=True)]
        return pa.table([rows["chunk"], rows["bucket"], pa.array(blobs, pa.binary())], ["chunk", "bucket", "repeats"])

    return wanted.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, repeats binary")


def covered(chunk: Chunk, found: dict, marks: list, length: int) -> np.ndarray:
    """Which bytes of the chunk lie in a repeated window."""
    change = np.zeros(len(chunk.data) + 1, np.int32)
    if marks and found["texts"]:
        repeats = np.concatenate([np.frombuffer(x["repeats"], np.uint64) for x in sorted(marks, key=lambda x: x["bucket"])])
        of = found["of"]
        bits = np.where(found["id"] == found["one"][of], repeats[of], all_windows(found["size"] + length - 1, length))
        for t in range(int(found["size"].max())):
            on = found["start"][((bits >> np.uint64(t)) & np.uint64(1)).astype(bool)] + t
            np.add.at(change, on, 1)
            np.add.at(change, on + length, -1)
    return np.cumsum(change[:-1]) > 0


def cut_out(joined: DataFrame, length: int, buckets: int) -> DataFrame:
    """Rows ``id, n_bytes, spans, kept`` of every document."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    arrow = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in each_row(batch):
                chunk = Chunk(r["data"], r["n_bytes"], r["ids"], r["sizes"])
                if r["marks"]:
                    gone = covered(chunk, candidates(chunk, r["shared"], length, buckets), r["marks"], length)
                else:
                    gone = np.zeros(len(chunk.data), bool)
                out, a = [], 0
                for key, size in zip(r["ids"], r["sizes"], strict=True):
                    z = a + size
                    mine = gone[a:z]
                    if mine.any():
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]])))
                        spans = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
                        kept = chunk.data[a:z][~mine].tobytes()
                    else:
                        spans, kept = [], chunk.bytes[a:z]
                    out.append({"id": key, "n_bytes": size, "spans": spans, "kept": kept})
                    a = z
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return joined.mapInArrow(run, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    chunk_bytes: int = 2 << 20,
    bucket_bytes: int = 8 << 20,
    slice_bytes: int = 2 << 20,
    most_chunks: int = 4096,
) -> DataFrame:
    """Per document its id (as ``id``), ``n_bytes``, the ``spans`` of bytes that it repeats, and the ``kept`` rest.

    A byte goes if it lies in ``length`` bytes of UTF-8 that also start in a
    document with a smaller id. Spans are maximal, from 0, end exclusive.
    ``kept`` is binary, since a cut may fall inside a character. Null texts are
    empty. Rows of one id are one document, so they don't repeat each other;
    rows without an id keep their text and count for nobody. Repeated rows come
    back each. Extra columns are ignored; an empty table gives an empty result.

    The other parameters bound memory and change no result: bytes of a chunk, of
    text a bucket, of strips indexed at a time, and the chunks that a key may
    be in before its windows are dealt out one by one.
    """
    spark = docs.sparkSession
    short_batches(spark)
    tables = Tables(spark)
    staged = tables.put(chunks(docs, id_col, text_col, chunk_bytes))
    total = staged.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    shared = tables.put(shared_keys(keys(staged, length, buckets), most_chunks))
    by_chunk = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "shared", "wide")).alias("shared"))
    marks = tables.put(answers(asked(staged.join(by_chunk, "chunk"), length, buckets), length, slice_bytes))
    marked = marks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "repeats")).alias("marks"))
    return cut_out(staged.join(by_chunk, "chunk", "left").join(marked, "chunk", "left"), length, buckets)

