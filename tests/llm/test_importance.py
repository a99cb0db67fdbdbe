import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafline.llm import importance, queries


def words_of(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", small)


def features(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(x):
    return zlib.crc32(x.encode()) % 10000


def brute(docs, target):
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x))))
    long = sorted((x for x in rows if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = Counter()
    for k, x in enumerate(long[: 5 * len(long) // 100]):
        drawn[(*x[:4], k + 1)] += 1
    rest = Counter(x[:4] for x in rows) - Counter(x[:4] for x in drawn.elements())
    return drawn + Counter({(*x, None): n for x, n in rest.items()})


@pytest.mark.parametrize("seed", range(20))
def test_checksums_of_joined_texts(seed):
    r = random.Random(seed)
    parts = [r.randbytes(r.choice([0, 1, 5, 300, 70_000])) for _ in range(60)]
    a, b = parts[:30], parts[30:]
    crc = lambda x: np.array([zlib.crc32(y) for y in x], np.uint32)
    assert importance.Checksums().joined(crc(a), crc(b), np.array([len(x) for x in b])).tolist() == crc([x + y for x, y in zip(a, b, strict=True)]).tolist()


@pytest.mark.parametrize("block_bytes", [1, 20, 200, 1 << 20])
def test_features_of_blocks(block_bytes):
    r = random.Random(block_bytes)
    texts = [None, "", "one", "Two words", "...", "É x\x00y 12a"] + ["".join(r.choice(["ab ", "C", ", ", "ßd ", "x-y "]) for _ in range(r.randrange(150))) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array([x if x is None else x.encode() for x in texts], pa.binary())], ["text"])
    found, count = Counter(), np.zeros(len(texts), np.int64)
    for b, row, rows, sizes in importance.places(batch, 0, 10000, block_bytes, importance.Checksums()):
        found.update(zip(row.tolist(), b.tolist(), strict=True))
        np.add.at(count, rows, sizes)
    assert found == Counter((i, bucket(f)) for i, x in enumerate(texts) for f in features(x))
    assert count.tolist() == [len(words_of(x)) for x in texts]


def test_against_brute_force(spark):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(["Alpha", "beta,", "gamma", "δelta", "x1", "the"]) for _ in range(n))
    docs = [(i, text(r.randrange(10, 60))) for i in range(150)] + [(3, None), (None, text(30)), (None, None), (5, ""), (9, "same words " * 20)] + [(9, "same words " * 20)] * 30
    target = [text(20), None, "gamma gamma δelta", ""]
    given = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, id string").repartition(3)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    wanted = brute(docs, target)
    for block in (100, 1 << 20):
        found = importance.resample(given, goal, block_bytes=block).select("id", "n_features", "weight", "score", "rank").collect()
        assert Counter(map(tuple, found)) == wanted
    assert sum(x[4] is not None for x in wanted.elements()) == 5 * sum(len(words_of(x)) >= 20 for _, x in docs) // 100


def test_without_target_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = docs.where("doc_id > 5")
    assert importance.resample(none, docs).collect() == []
    found = importance.resample(docs, none.select("text")).select("id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, found)) == brute([(1, "a b c"), (2, None)], [])


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.001"
    found = queries.queries()["op11_ngram_importance"](spark, data).select("doc_id", "n_features", "weight", "score", "rank").collect()
    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert Counter(map(tuple, found)) == brute(docs, [x["text"] for x in spark.read.parquet(f"{data}/benchmark.parquet").collect()])
