import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.llm import passages, queries
from leafline.llm.runindex import RunIndex

SCHEMA = "doc_id long, text string, id string"


def laid(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


@pytest.mark.parametrize("seed", range(60))
def test_matching_statistics(seed):
    r = random.Random(seed)
    letters = r.choice([2, 3, 5])
    texts = [bytes(r.randrange(letters) for _ in range(r.randrange(1, r.choice([6, 40])))) for _ in range(r.randrange(1, 12))]
    classes = [r.randrange(3) for _ in texts]
    patterns = [bytes(r.randrange(letters + 1) for _ in range(r.randrange(1, r.choice([6, 40])))) for _ in range(6)] + [r.choice(texts)]
    asked = [r.randrange(3) for _ in patterns]
    found = RunIndex(*laid(texts), np.array(classes)).statistics(*laid(patterns), np.array(asked))
    wanted = []
    for p, c in zip(patterns, asked, strict=True):
        for i in range(len(p)):
            n = 0
            while i + n < len(p) and any(p[i : i + n + 1] in t for t, k in zip(texts, classes, strict=True) if k == c):
                n += 1
            wanted.append(n)
    assert found.tolist() == wanted


def test_runs_of_a_repetitive_text_are_few():
    one = bytes(random.Random(5).randrange(256) for _ in range(200))
    index = RunIndex(*laid([one] * 50), np.zeros(50, np.int64))
    assert len(index.first) <= 203


def brute(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < i:
                    gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i if i is not None else -1, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def digest(found):
    rows = found.select("id", "n_bytes", "spans", "kept").collect()
    return sorted((r["id"] if r["id"] is not None else -1, r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in rows)


def corpus(seed, docs, letters="ab "):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [text(r.randrange(30, 140)) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [r.choice([r.choice(shared), text(r.randrange(40)), r.choice(shared)[: r.randrange(90)], "é" * r.randrange(3)]) for _ in range(r.randrange(6))]
        rows.append((r.randrange(docs), "".join(parts)))
    rows += [(3, None), (None, shared[0] * 3), (None, None), (5, ""), rows[0], rows[1], (docs + 1, "ab" * 400), (docs + 2, "b" + "ab" * 300), (0, shared[1]), (docs + 3, rows[0][1]), (docs + 4, rows[0][1])]
    return rows


@pytest.mark.parametrize("length,options", [(50, {}), (50, {"chunk_bytes": 700, "bucket_bytes": 900, "slice_bytes": 500}), (50, {"chunk_bytes": 500, "bucket_bytes": 2000, "most_chunks": 0}), (20, {"chunk_bytes": 900, "most_chunks": 2}), (100, {"chunk_bytes": 2000})])
def test_against_brute_force(spark, length, options):
    for seed, letters in ((1, "ab "), (2, "abcdefghijklmnopqrstuvwxyz   ")):
        rows = corpus(seed, 70, letters)
        docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(3)
        wanted = brute(rows, length)
        assert digest(passages.repeated_passages(docs, length=length, **options)) == wanted
        assert sum(x[2] for x in wanted) > 500


def test_empty_table(spark):
    assert passages.repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None), (2, ""), (None, "a")]
    assert digest(passages.repeated_passages(spark.createDataFrame([(*r, "") for r in rows], SCHEMA))) == brute(rows, 50)


def test_long_texts_and_parts_of_hashing(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long), (2, "x" + long[1000:200_000] + "yy" + long[250_000:]), (3, "z" * 3000), (4, "z" * 2000)]
    found = {x[0]: x for x in digest(passages.repeated_passages(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), chunk_bytes=100_000))}
    assert [found[i][2:4] for i in (1, 2, 3, 4)] == [(0, 0), (199_000 + 150_000, 2), (0, 0), (2000, 1)]


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    found = queries.queries()["op12_run_length_index"](spark, data)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute(rows, 50)
    assert found.where("n_removed > 0").count() > 3
    assert found.select(F.sum("n_removed")).first()[0] > 500


def strips(seed, groups=5, length=12):
    """Strips of documents that share passages, each group in letters of its own: data, starts, sizes, groups and ids, and the bits that their windows' first documents give."""
    r = random.Random(seed)
    shared = ["".join(r.choice("abcd") for _ in range(60)) for _ in range(4)]
    texts, group, ids = [], [], []
    for _ in range(300):
        part = r.choice(shared)
        at = r.randrange(40)
        mine = r.randrange(groups)
        text = bytes(c + 4 * mine for c in (part[at : at + r.randrange(12, 40)] + "".join(r.choice("abcd") for _ in range(r.randrange(12)))).encode())
        if len(text) >= length and text not in texts:
            texts.append(text)
            group.append(mine)
            ids.append(r.randrange(40))
    first = {}
    for t, g, i in zip(texts, group, ids, strict=True):
        for k in range(len(t) - length + 1):
            first[g, t[k : k + length]] = min(i, first.get((g, t[k : k + length]), i))
    bits = [sum(1 << k for k in range(len(t) - length + 1) if first[g, t[k : k + length]] < i) for t, g, i in zip(texts, group, ids, strict=True)]
    return (*laid(texts), np.array(group), np.array(ids), length), bits


@pytest.mark.parametrize("seed", range(8))
def test_strips_are_indexed_once(monkeypatch, seed):
    """one index a slice, of the documents that hashes of windows name; by halves it was one for each doubling of a group's documents."""
    built, whole = [], passages.RunIndex
    monkeypatch.setattr(passages, "RunIndex", lambda *x: built.append(1) or whole(*x))
    given, bits = strips(seed)
    assert passages.repeated_windows(*given).tolist() == bits and sum(bits)
    assert len(built) == 1
    assert passages.halved_windows(*given).tolist() == bits
    assert len(built) > 3


@pytest.mark.parametrize("bits", [1, 4, 9])
def test_hashes_of_other_windows_change_nothing(monkeypatch, bits):
    """where a hash names a document that doesn't hold the window, its group is done by halves."""
    whole, halved, hashes = passages.halved_windows, [], passages.window_hashes
    monkeypatch.setattr(passages, "window_hashes", lambda *x: hashes(*x) & np.uint64((1 << bits) - 1))
    monkeypatch.setattr(passages, "halved_windows", lambda *x: halved.append(1) or whole(*x))
    for seed in range(5):
        given, wanted = strips(seed)
        assert passages.repeated_windows(*given).tolist() == wanted
    assert halved
