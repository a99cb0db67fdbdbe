"""Words and word n-grams of whole Arrow batches as 64-bit numbers.

Everything here works on the bytes of a batch of texts at once, so a very long
text costs no more a byte than a short one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BYTES = np.random.Generator(np.random.PCG64(20240901)).integers(0, 2**64, 256, np.uint64)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]

#: 0 white space, 1 letters and all bytes of other characters, 2 digits, 3 the rest
_KIND = np.full(256, 3, np.uint8)
_KIND[_SPACE] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def slices(texts: pa.Array, most: int = 1 << 20):
    """Consecutive slices of ``texts`` of about ``most`` bytes, one text at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    large = texts.cast(pa.large_string())
    ends = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield start, large.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``texts`` and where each text begins and ends; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def words(texts: pa.Array, by_kind: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the index of its text, in order.

    A word is a longest run of bytes other than the six ASCII white spaces,
    with A-Z in lower case. ``by_kind`` keeps the case and ends a word also
    where letters, digits and other signs meet.
    """
    data, ends = raw(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _KIND[data] if by_kind else (~_SPACE[data]).view(np.uint8)
    first = np.empty(len(data), bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    begins = ends[:-1]
    first[begins[begins < len(data)]] = True
    first &= kind != 0
    inside = np.flatnonzero(kind)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.flatnonzero(first)
    at = np.searchsorted(inside, starts)
    lengths = np.diff(np.append(at, len(inside)))
    place = np.arange(len(inside)) - np.repeat(at, lengths)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _STEP)]), dtype=np.uint64)
    values = (_BYTES if by_kind else _LOWER)[data[inside]]
    values *= powers[place]
    hashed = np.add.reduceat(values, at)
    return mix(hashed), np.searchsorted(ends, starts, "right") - 1


def pairs(hashed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each two neighbouring words of a text."""
    same = owner[1:] == owner[:-1]
    return mix(hashed[:-1] * np.uint64(0xA24BAED4963EE407) + hashed[1:])[same], owner[:-1][same]


def shingle_sets(texts: pa.Array, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``size``-word shingles of each text, sorted, and their bounds.

    A text of fewer words has its whole sequence as the one shingle; a text
    without words has none. The set of text i is ``found[bounds[i]:bounds[i + 1]]``.
    """
    hashed, owner = words(texts)
    n = len(texts)
    counts = np.bincount(owner, minlength=n)
    if not len(hashed):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    value, alive = hashed.copy(), np.ones(len(hashed), bool)
    first = np.cumsum(counts) - counts
    left = first[owner] + counts[owner] - np.arange(len(hashed))  # words from here to the end of the text
    for k in range(1, size):
        more = np.flatnonzero(left > k)
        value[more] = mix(value[more] * np.uint64(0xA24BAED4963EE407) + hashed[more + k] + np.uint64(k))
    short = counts[owner] < size
    alive = np.where(short, left == counts[owner], left >= size)
    value, owner = value[alive], owner[alive]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(n + 1))


def shingle_sets_of_many(texts: pa.Array, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, a slice at a time, so that what it needs besides its result stays small."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, part in slices(texts):
        values, bounds = shingle_sets(part, size)
        found.append(values)
        counts.append(np.diff(bounds))
    return np.concatenate(found), np.cumsum(np.concatenate(counts))
