import random
import re

import pyarrow as pa
import pytest

from leafline.llm import hashing, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(texts, size, percent):
    """Components by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in texts}
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sets, label


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    texts = ["", None, "   \t\n", "one", "ONE", "one two", "One  TWO", "naïve É é", "naïve É É", "x" * 50_000]
    shared = " ".join(rng.choices(words, k=60))
    while len(texts) < n:
        kind = rng.random()
        text = rng.choice(base).split()
        if kind < 0.7:
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
        elif kind < 0.85:
            texts.append(shared + " " + " ".join(rng.choices(words, k=20)))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(1, 80))))
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("pairs_in_bucket", [0, 2000])
def test_components_and_sizes(spark, size, pairs_in_bucket):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, id string, n int").repartition(5)
    sets, label = brute(texts, size, 80)
    hubs = (1,) if pairs_in_bucket == 0 else (1, 2, 6)
    rows = minhash.near_duplicates(docs, size=size, hubs=hubs, pairs_in_bucket=pairs_in_bucket, block_rows=50).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == label
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("block_rows", [7, 500])
def test_family_blocks_find_every_link(spark, block_rows):
    texts = [(i, t) for i, t in corpus(120) if shingles(t, 2)]
    sets = {i: shingles(t, 2) for i, t in texts}
    component = {i: i if i % 3 else 0 for i in sets}
    wanted = {(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    members = spark.createDataFrame([(5, i, component[i], t) for i, t in texts], "family long, id long, component long, text string")
    assert {(r["a"], r["b"]) for r in minhash._family_links(members, 2, 80, block_rows).collect()} == wanted


def test_null_ids_and_repeated_rows(spark):
    text = "the same few words in every row of this table"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text), (None, "alone here now")], "doc_id long, text string")
    rows = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, size=2).collect()]
    assert sorted(rows, key=str) == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (9, 7, False), (None, None, False)], key=str)
    kept = minhash.keep_first(docs, size=2).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 7), (True, 0), (True, 0)]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingle_hashes_match_sets():
    texts = [t for _, t in corpus(60)]
    for size in (1, 2, 3, 5):
        found, bounds = hashing.shingle_sets(pa.array(texts), size)
        sets = [shingles(t, size) for t in texts]
        assert [bounds[i + 1] - bounds[i] for i in range(len(texts))] == [len(s) for s in sets]
        for a in range(0, 60, 7):
            for b in range(0, 60, 5):
                shared = len(set(found[bounds[a] : bounds[a + 1]].tolist()) & set(found[bounds[b] : bounds[b + 1]].tolist()))
                assert shared == len(sets[a] & sets[b])
