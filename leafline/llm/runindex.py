"""A run-length index of many short texts and the matching statistics streamed against it.

The index is the Burrows-Wheeler transform of the texts, kept as its runs, with
the text positions of the first and the last row of every run. Patterns are
streamed from their ends: while the row's run holds the next symbol the match
grows by a step back in the transform; otherwise it moves to the nearest run with
that symbol above or below, whose sampled position tells how much of the match
is left. All patterns take their steps together, as arrays.

Texts are of classes, and a pattern only meets texts of its own class.
"""

from __future__ import annotations

import numpy as np

PACKED = 7  # symbols of nine bits in a word


def packed_words(symbols: np.ndarray) -> np.ndarray:
    """The next seven symbols from every place as one number, zeros behind the end mark 0."""
    padded = np.concatenate([symbols, np.zeros(PACKED, symbols.dtype)])
    words, open_ = np.zeros(len(symbols), np.int64), np.ones(len(symbols), bool)
    for t in range(PACKED):
        here = padded[t : t + len(symbols)]
        words = (words << 9) | np.where(open_, here, 0)
        open_ &= here != 0
    return words


def suffix_order(symbols: np.ndarray, left: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Suffixes by class, then by their text up to its end mark, equal ones by place.

    ``left`` has the symbols from each place to its end mark, this included.
    Ranks of doubled prefixes, worked out only where suffixes still tie.
    """
    order = np.lexsort((words, classes)) if classes.any() else np.argsort(words, kind="stable")
    n, key = len(symbols), words[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (np.diff(classes[order]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    size = PACKED
    while size < left.max(initial=0):
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        members = order[slots]
        behind = np.where(left[members] > size, rank[np.minimum(members + size, n - 1)], 0)
        key = rank[members] * (n + 2) + behind
        by = np.argsort(key, kind="stable")
        members, key = members[by], key[by]
        order[slots] = members
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        rank[members] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        size *= 2
    return order


class RunIndex:
    """Index of the texts ``data[starts[i] : starts[i] + sizes[i]]`` (bytes), each of a class."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, classes: np.ndarray):
        ends = np.cumsum(sizes + 1)
        n = int(ends[-1])
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        symbols[inside] = data[spread(starts, sizes)].astype(np.int64) + 1
        of = np.repeat(classes.astype(np.int64), sizes + 1)
        left = np.repeat(ends, sizes + 1) - np.arange(n)
        self.words = packed_words(symbols)
        order = suffix_order(symbols, left, of, self.words)
        before = np.where(order > 0, symbols[order - 1], 0)
        code = np.where(before > 0, of[order] * 257 + before, -1)
        change = np.ones(n, bool)
        change[1:] = code[1:] != code[:-1]
        self.first = np.flatnonzero(change)
        self.last = np.append(self.first[1:], n) - 1
        self.code = code[self.first]
        self.head, self.tail = order[self.first], order[self.last]  # the sampled positions
        real = np.flatnonzero(self.code >= 0)
        self.runs = real[np.argsort(self.code[real], kind="stable")]  # by symbol, then by place
        self.keys = self.code[self.runs] * (len(self.first) + 1) + self.runs
        # rows that begin with a symbol lie together, in the order of the rows that it precedes
        plain = of * 257 + symbols
        values, counts = np.unique(plain, return_counts=True)
        base = np.cumsum(counts) - counts
        sizes_of = (self.last - self.first + 1)[self.runs]
        passed = np.cumsum(sizes_of) - sizes_of
        owner = self.code[self.runs]
        start = np.ones(len(owner), bool)
        start[1:] = owner[1:] != owner[:-1]
        at = np.maximum.accumulate(np.where(start, np.arange(len(owner)), 0)) if len(owner) else owner
        # where a run's first row goes by a step back: a run, and how far into it
        self.size = self.last - self.first + 1
        self.goes, self.into = np.zeros(len(self.first), np.int64), np.zeros(len(self.first), np.int64)
        if len(owner):
            to = base[np.searchsorted(values, owner[start])][np.cumsum(start) - 1] + passed - passed[at]
            self.goes[self.runs] = np.searchsorted(self.first, to, side="right") - 1
            self.into[self.runs] = to - self.first[self.goes[self.runs]]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that the texts from ``a`` and from ``b`` have in common, ``most`` at most."""
        found, go = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(go):
            x = self.words[a[go] + found[go]] ^ self.words[b[go] + found[go]]
            same = np.zeros(len(go), np.int64)
            for t in range(1, PACKED + 1):
                same += (x >> (63 - 9 * t)) == 0
            found[go] += same
            go = go[(same == PACKED) & (found[go] < most[go])]
        return np.minimum(found, most)

    def statistics(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Per place of every pattern, one pattern after the other, the length of its longest match in the index."""
        out = np.zeros(int(sizes.sum()), np.int64)
        at = np.cumsum(sizes)
        by = np.argsort(-sizes, kind="stable")
        shift, ends, active = classes.astype(np.int64)[by] * 257, (starts + sizes)[by], sizes[by]
        at = at[by]
        run, ahead = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        place = np.full(len(by), self.head[0], np.int64)
        length = np.zeros(len(by), np.int64)
        many = len(self.first) + 1
        for j in range(int(active[0]) if len(active) else 0):
            n = int(np.searchsorted(-active, -j))  # those longer than j
            code = shift[:n] + data[ends[:n] - 1 - j] + 1
            at_run, at_ahead = run[:n], ahead[:n]
            miss = np.flatnonzero(self.code[at_run] != code)
            place[:n] -= 1
            length[:n] += 1
            if len(miss):
                c, k = code[miss], at_run[miss]
                below = np.searchsorted(self.keys, c * many + k)
                down, up = self.runs[np.minimum(below, len(self.runs) - 1)], self.runs[np.maximum(below - 1, 0)]
                has_below, has_above = self.code[down] == c, self.code[up] == c
                left, here = length[miss] - 1, place[miss] + 1
                one = np.where(has_above, self.common(here, self.tail[up], np.where(has_above, left, 0)), -1)
                two = np.where(has_below, self.common(here, self.head[down], np.where(has_below, left, 0)), -1)
                takes_up = one >= two
                found = has_above | has_below
                to = np.where(takes_up, up, down)
                length[miss] = np.maximum(one, two) + 1
                place[miss] = np.where(found, np.where(takes_up, self.tail[to], self.head[to]) - 1, here)
                stay = miss[~found]
                kept = at_run[stay], at_ahead[stay]
                at_run[miss] = to
                at_ahead[miss] = np.where(takes_up, self.size[to] - 1, 0)
            at_ahead += self.into[at_run]
            at_run[:] = self.goes[at_run]
            beyond = np.flatnonzero(at_ahead >= self.size[at_run])
            while len(beyond):
                at_ahead[beyond] -= self.size[at_run[beyond]]
                at_run[beyond] += 1
                beyond = beyond[at_ahead[beyond] >= self.size[at_run[beyond]]]
            if len(miss):
                at_run[stay], at_ahead[stay] = kept
            out[at[:n] - 1 - j] = length[:n]
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the stretches, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
