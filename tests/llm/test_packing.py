import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafline.llm import packing

SCHEMA = "doc_id long, text string, piece string"
TEXTS = ["", None, "a b c", "<|endoftext|> is text", "x" * 9000, "naïve 中文   tabs\t\tand   spaces", "word " * 3000, "a b c"]


CODER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


RANKED = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def ids_of(text):
    return np.array([*CODER.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def held(rows, texts, capacity):
    """Every document whole, every sequence gapless and within its capacity."""
    found = Counter()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        found[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = Counter()
    for doc_id, text in texts:
        ids = ids_of(text)
        for piece, (start, length) in enumerate(packing.cuts(len(ids), capacity)):
            wanted[(doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))] += 1
    assert found == wanted
    return len(by_sequence)


def test_whole_documents(spark):
    texts = [*enumerate(TEXTS), (None, "no id"), (3, "<|endoftext|> is text"), (3, "<|endoftext|> is text")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], SCHEMA)
    rows = packing.pack(docs, capacity=1024).collect()
    held(rows, texts, 1024)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "word", "naïve 中", "'s", "12", "\u2028", "<|", "é"]), max_size=12).map("".join) | st.text(max_size=60))
def test_ids_are_those_of_the_tokenizer_file(text):
    assert [*RANKED.encode(text, allowed_special="all"), 2] == ids_of(text).tolist()


def test_small_groups_give_each_rank_once(spark):
    texts = [(i, "word " * (i % 9)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "") for i, t in texts], SCHEMA)
    held(packing.pack(docs, capacity=16, rows_in_group=7).collect(), texts, 16)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def sequential(lengths, capacity):
    """Best-two-fit, one document after the other."""
    left = Counter(lengths)
    bins = []
    while +left:
        bin_, gap = [], capacity

        def largest(most):
            return max((x for x in left if left[x] > 0 and x <= most), default=0)

        while gap and (take := largest(gap)):
            bin_.append(take)
            left[take] -= 1
            gap -= take
        if gap:
            smallest = bin_[-1]
            room, best, pair = gap + smallest, smallest, None
            left[smallest] += 0
            names = sorted(x for x in left if left[x] > 0)
            for i, a in enumerate(names):
                for b in names[i:]:
                    if best < a + b <= room and (a != b or left[a] > 1):
                        best, pair = a + b, (a, b)
            if pair:
                left[smallest] += 1
                bin_.pop()
                for x in pair:
                    bin_.append(x)
                    left[x] -= 1
        bins.append(sum(bin_))
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=80))
def test_patterns_take_every_length(lengths):
    found = packing.patterns(Counter(lengths), 40)
    taken = Counter()
    for repeats, bin_ in found:
        assert sum(bin_) <= 40
        for x in bin_:
            taken[x] += repeats
    assert taken == Counter(lengths)
    assert sum(r for r, _ in found) <= len(sequential(lengths, 40)) + 1


@pytest.mark.parametrize("total", [1, 1023, 1024, 1025, 5000])
def test_only_the_first_piece_is_short(total):
    found = packing.cuts(total, 1024)
    assert sum(n for _, n in found) == total
    assert all(n == 1024 for _, n in found[1:])
