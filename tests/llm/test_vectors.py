import numpy as np
from pyspark.sql import functions as F

from leafline.llm import collisions, crosspolytope


def cloud(n=400, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    rows = list(rng.standard_normal((n, dim)))
    for i in range(0, 120):
        rows.append(rows[i % 20] + rng.standard_normal(dim) * rng.uniform(0, 0.6))
    rows += [rows[0], rows[0], rows[1] * 3.0]
    return [r.tolist() for r in rows]


def spoiled(dim):
    return [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]


def test_links_and_components(spark):
    good = cloud()
    rows = [(i, v, "x") for i, v in enumerate(good + spoiled(16))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string").repartition(3)
    x = np.array(good)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        low = np.minimum(label, np.where(near, label[None], len(x)).min(1))
        if (low == label).all():
            break
        label = low
    for block_rows in (16384, 100):
        found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in collisions.near_duplicate_vectors(frame, block_rows=block_rows).collect()}
        wanted = {i: (int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))}
        wanted |= {len(x) + i: (0, len(x) + i, True) for i in range(5)}
        assert found == wanted


def test_recall_at_the_limit():
    width, least = collisions.calibrated(0.9, 0.9999)
    rng = np.random.default_rng(1)
    a = rng.standard_normal((3000, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((3000, 48))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    lines = collisions.lines_of(48)
    hits = sum((q == c).sum() for q, c in collisions.collided(a @ lines, b @ lines, width, least))
    assert hits >= 0.999 * 3000


def test_counts_are_exact():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (37, 5, 64)).astype(np.uint8)
    packed = [np.packbits(b, axis=1, bitorder="little").view(np.uint64) for b in bits]
    digits = collisions.counted(iter([p.copy() for p in packed]))
    total = sum(np.unpackbits(d.view(np.uint8), axis=1, bitorder="little").astype(int) << i for i, d in enumerate(digits))
    assert (total == bits.sum(0)).all()


def test_empty_and_unusable(spark):
    schema = "vec_id long, embedding array<double>"
    assert collisions.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = collisions.near_duplicate_vectors(spark.createDataFrame([(1, None), (None, [1.0])], schema)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in rows) == [("1", 0, True), ("None", 0, False)]
    none = spark.createDataFrame([], schema)
    assert crosspolytope.search(none, none).count() == 0


def test_nearest(spark):
    good = cloud()
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(good + spoiled(16))], "vec_id long, embedding array<double>, id string")
    queries = frame.where("vec_id % 10 = 0")
    x = np.array(good)
    hits = total = 0
    for block_rows in (8192, 64):
        found = {}
        for r in crosspolytope.search(frame, queries, block_rows=block_rows, query_rows=16).collect():
            found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q in range(0, len(x), 10):
            away = np.sqrt(((x - x[q]) ** 2).sum(1))
            wanted = [i for i in np.lexsort((np.arange(len(x)), away)) if i != q][:10]
            got = sorted(found[q])
            assert [g[0] for g in got] == list(range(1, 11))
            assert all(abs(g[2] - away[g[1]]) < 1e-12 for g in got)
            assert [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
            hits += len({g[1] for g in got} & set(wanted))
            total += 10
    assert hits >= 0.9 * total


def test_few_candidates_are_all_returned(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    rows = crosspolytope.search(frame, frame.where("vec_id = 0")).collect()
    assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3]


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((50, 24))
    turned = crosspolytope.rotated(x, 3)
    assert np.allclose((turned**2).sum(1), (x**2).sum(1))


def random_units(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def share_and_recall(spark, x, queries, probes):
    """Share of the rows that are candidates, and recall of the ten nearest, both by brute force."""
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, v array<double>").repartition(4)
    asked = frame.where(f"row < {queries}").withColumnRenamed("row", "id")
    met = {(r["query"], r["row"]) for r in crosspolytope.candidates(frame, asked, {x.shape[1]: len(x)}, 20, probes, 256).collect()}
    hits = 0
    for q in range(queries):
        away = ((x - x[q]) ** 2).sum(1)
        away[q] = np.inf
        hits += sum((q, i) in met for i in np.argsort(away)[:10].tolist())
    return len(met) / (queries * len(x)), hits / (10 * queries)


def test_near_rows_are_found_among_few_candidates(spark):
    centres = random_units(300, 64, 1)
    rng = np.random.default_rng(2)
    x = np.repeat(centres, 12, 0) + rng.standard_normal((3600, 64)) * 0.05
    share, recall = share_and_recall(spark, rng.permutation(x), 60, 20)
    assert share < 0.05 and recall >= 0.95


def test_rows_without_structure(spark):
    share, recall = share_and_recall(spark, random_units(3000, 64, 3), 60, None)
    assert share < 0.35 and recall >= 0.9


def test_share_falls_as_rows_grow():
    shares = [crosspolytope.probes_for(n, 64, 20) * 20 / 128**2 for n in (500, 5000, 50_000, 5_000_000)]
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.03


def recall_of_search(spark, x, asked):
    """Recall of the ten nearest found, by brute force."""
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {(r["query_id"], r["vec_id"]) for r in crosspolytope.search(frame, frame.where(F.col("vec_id").isin(asked))).collect()}
    hits = 0
    for q in asked:
        away = ((x - x[q]) ** 2).sum(1)
        away[q] = np.inf
        hits += sum((q, i) in got for i in np.argsort(away)[:10].tolist())
    return hits / (10 * len(asked))


def test_exact_distances_grow_slower_than_rows(spark, monkeypatch):
    ranked, counts = crosspolytope._ranked, []

    def counting(pairs, *rest):
        counts.append(pairs.count())
        return ranked(pairs, *rest)

    monkeypatch.setattr(crosspolytope, "_ranked", counting)
    x, made = random_units(12_000, 64, 7), []
    for n in (3000, 12_000):
        counts.clear()
        assert recall_of_search(spark, x[:n], list(range(40))) >= 0.9
        made.append(sum(counts))
    assert made[1] < 1.9 * made[0]


def test_recall_of_other_widths_and_lengths(spark):
    for dim, spread in ((3, 0.3), (24, 0.3), (200, 0.0)):
        rng = np.random.default_rng(dim)
        x = rng.standard_normal((1500, dim)) * rng.lognormal(0, spread, (1500, 1)) + 0.2
        assert recall_of_search(spark, x, list(range(0, 1500, 25))) >= 0.9


def test_signs_tell_angles():
    rng = np.random.default_rng(4)
    for dim in (2, 3, 64, 300):
        a = random_units(500, dim, dim)
        b = rng.standard_normal((500, dim))
        b -= (a * b).sum(1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        for angle in (0.0, 0.3, 1.2, np.pi):
            c = np.cos(angle) * a + np.sin(angle) * b
            differ = [np.bitwise_count((crosspolytope.signs(a, t) ^ crosspolytope.signs(c, t)).view(np.uint64)).sum(1).mean() for t in range(20)]
            assert abs(np.mean(differ) / crosspolytope.SIGNS - angle / np.pi) < 0.01
    assert np.allclose(crosspolytope.lengths(np.array([[3e200, 4e200], [0.0, 5e-324]])), [5e200, 5e-324], rtol=1e-12, atol=0)


def test_search_ties_lengths_repeats_and_extremes(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(20, 40)] + [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (5, [0.0, 1.0]), (6, [0.0, 2.0]), (None, [1.0, 0.0, 0.0])]
    rows += [(50, [1e200, 0.0, 0.0]), (51, [3e200, 0.0, 0.0]), (52, [-0.0, 1.0]), (53, [1e-300, 0.0, 0.0, 0.0]), (54, [3e-300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in crosspolytope.search(frame, frame.where("vec_id in (0, 5, 50, 53)"), k=3).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found[0]) == [(1, 20, 0.0), (2, 21, 0.0), (3, 22, 0.0)]
    assert sorted(found[5]) == [(1, 52, 0.0), (2, 6, 1.0)]
    assert sorted(found[50])[0] == (1, 0, 1e200) and len(found[50]) == 3
    assert [x[:2] for x in sorted(found[53])] == [(1, 54)] and abs(found[53][0][2] / 2e-300 - 1) < 1e-12


def test_joined_queries_give_the_same(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(cloud())], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 25 = 0")
    a, b = (sorted(map(tuple, crosspolytope.search(frame, asked, query_bytes=n).collect())) for n in (0, 1 << 24))
    assert [x[:3] for x in a] == [x[:3] for x in b]


def test_links_of_extreme_vectors_and_mixed_lengths(spark):
    rows = [(0, [1e200, 0.0]), (1, [2e200, 0.0]), (2, [1e-200, 0.0]), (3, [3e-200, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0, 0.0]), (6, [0.0, 5e-324]), (7, [0.0, 1.0]), (8, [-1.0, 0.0]), (9, [1.0]), (9, [1.0]), (10, [4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collisions.near_duplicate_vectors(frame).collect()}
    assert found == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (1, 9), 10: (1, 9)}
