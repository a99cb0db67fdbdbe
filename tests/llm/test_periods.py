import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from leafline.llm import periods, queries


def brute(words, least, times):
    """Every maximal run, period by period."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                w = words[i : j + q]
                if not any(all(w[k] == w[k + p] for k in range(len(w) - p)) for p in range(1, q)):
                    found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(words, runs):
    gone = [False] * len(words)
    for s, n, q in runs:
        gone[s + q : s + n] = [True] * (n - q)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def made(r):
    words = []
    for _ in range(r.randrange(6)):
        unit = [r.randrange(r.choice([2, 3, 30])) for _ in range(r.randrange(1, 9))]
        words += unit * r.randrange(1, r.choice([3, 12])) + unit[: r.randrange(len(unit))]
        words += [r.randrange(4) for _ in range(r.randrange(4))]
    return words


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (9, 4)])
def test_runs_against_brute_force(seed, least, times):
    r = random.Random(seed)
    texts = [made(r) for _ in range(8)] + [[7] * 60, [1, 2] * 31, []]
    sizes = np.array([len(t) for t in texts], np.int64)
    start, length, period = periods.maximal_runs(np.array([w for t in texts for w in t], np.int64), sizes, least, times)
    wanted, base = [], 0
    for t in texts:
        wanted += [(s + base, n, q) for s, n, q in brute(t, least, times)]
        base += len(t)
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == wanted


def digests(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 24, 3)
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(collapsed(words, runs))
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    texts = ["", None, " \t ", "one", "a\x1cb c " * 30, "é ü " * 40, "x " * 25, "ab cd " * 12, "\n".join(["same line again"] * 9)]
    texts += [" ".join(f"w{w}" for w in made(r)) for _ in range(150)]
    rows = [(i, t, "id") for i, t in enumerate(texts)] + [(7, texts[6], "again"), (None, "z " * 30, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string, id string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["op13_suffix_tree_runs"](spark, str(tmp_path)).select(COLUMNS).collect()
    wanted = [digests(i, t) if i is not None else (None, *digests(1, t)[1:]) for i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[6])
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    assert sum(x[1] > 0 for x in wanted) > 60


def test_query_on_given_tables(spark):
    data = "/root/testdata/sf0.001"
    found = queries.queries()["op13_suffix_tree_runs"](spark, data).select(COLUMNS).collect()
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{data}/documents.parquet").collect() if len((x["text"] or "").split()) < 900]
    held = {x[0]: tuple(x) for x in found}
    assert len(docs) > 150 and [held[i] for i, _ in docs] == [digests(i, t) for i, t in docs]


def test_long_text_and_empty_table(spark):
    text = "a b c " * 40_000 + " ".join(f"u{i}" for i in range(50_000)) + " end" * 30_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = periods.periodic_runs(docs).first()
    assert [tuple(x) for x in found["runs"]] == [(0, 120_000, 3), (170_000, 30_000, 1)]
    assert found["n_words"] == 200_000 and found["collapsed"].startswith("a b c u0 u1 ") and found["collapsed"].endswith(" u49999 end")
    assert periods.periodic_runs(docs.where("doc_id > 5")).collect() == []
