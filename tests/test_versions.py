"""Versions of tables, stores of artifacts, and hints as a stream."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafline.sources import store, versions
from leafline.sources.artifacts import artifacts
from leafline.streaming import hints


def test_a_version_is_whole_or_not_there(spark, tmp_path):
    root = f"{tmp_path}/trees"
    with pytest.raises(versions.NoVersion):
        versions.read(spark, root, "nodes")
    first = {"nodes": spark.range(3), "modules": spark.range(2).withColumn("m", F.lit("x"))}
    assert versions.commit(spark, root, first) == 1
    broken = spark.range(5).withColumn("y", F.expr("if(id = 4, raise_error('stop'), id)"))
    with pytest.raises(Exception, match="stop"):
        versions.commit(spark, root, {"nodes": spark.range(9), "modules": broken})
    assert versions.read(spark, root, "nodes").count() == 3 and versions.read(spark, root, "modules").columns == ["id", "m"]
    assert versions.commit(spark, root, {"nodes": spark.range(9), "modules": spark.range(0)}) == 2
    assert (versions.read(spark, root, "nodes").count(), versions.read(spark, root, "modules").count(), versions.read(spark, root, "nodes", 1).count()) == (9, 0, 3)
    with pytest.raises(versions.NoVersion):
        versions.read(spark, root, "steps")


def test_a_number_taken_twice_is_told(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/trees"
    versions.commit(spark, root, {"t": spark.range(1)})
    plain = versions._chosen
    # a second writer that looked before the first was done, with a folder name behind the first's
    monkeypatch.setattr(versions, "_chosen", lambda s, r, v: plain(s, r, v) if v is not None else None)
    monkeypatch.setattr(versions.uuid, "uuid4", lambda: type("U", (), {"hex": "z" * 32})())
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, {"t": spark.range(5)})
    monkeypatch.undo()
    assert versions.read(spark, root, "t").count() == 1


def test_trees_of_raw_content(spark, tmp_path):
    good = json.dumps([{"type": "text", "text": "1 A", "text_level": 1, "page_idx": 0}, {"type": "text", "text": "body", "page_idx": 0}, {"type": "text", "text": "1.1 B", "text_level": 2, "page_idx": 1}])
    docs = spark.createDataFrame([(1, good), (2, None), (3, "[{"), (4, "{}"), (5, "[]")], "doc_id int, content string")
    versions.commit(spark, f"{tmp_path}/t", versions.tree_tables(docs))
    read = lambda name: versions.read(spark, f"{tmp_path}/t", name)
    assert [(x["doc_id"], x["status"], x["error"], x["headings"]) for x in read("status").orderBy("doc_id").collect()] == [(1, "completed", None, 2), (2, "error", "missing", 0), (3, "error", "no_json", 0), (4, "error", "no_list", 0), (5, "error", "empty", 0)]
    assert [(x["node_id"], x["parent_id"], x["page_no"]) for x in read("nodes").orderBy("ord").collect()] == [("n1", None, 1), ("n3", "n1", 2)]
    assert [x["members"] for x in read("modules").orderBy("module_id").collect()] == [2, 1]


def test_artifacts_that_a_join_names(spark, tmp_path):
    rows = spark.range(200).withColumn("v", F.col("id") * 2)
    held = artifacts(rows, "id", "run", ["id", "v"]).withColumn("kind", F.lit("run"))
    bad = spark.createDataFrame([("run", "300", "{", None), ("run", "301", "{}", "0"), ("run", "7", "{}", "0")], "kind string, id string, body string, content_hash string").withColumn("content_hash", F.coalesce("content_hash", F.sha2("body", 256)))
    path = f"{tmp_path}/store"
    store.put(held, path, 16)
    store.put(bad, path, 16)
    kept = {r["id"]: r for r in held.where("id in (5, 7)").collect()}
    wanted = spark.createDataFrame([("run", 5, None, "a"), ("run", 5, kept[5]["content_hash"], "b"), ("run", 5, "other", "c"), ("run", 7, None, "d"), ("run", 300, None, "e"), ("run", 301, None, "f"), ("run", 999, None, "g"), ("none", 5, None, "h"), ("run", None, None, "i"), ("run", 5, None, "a")], "kind string, id int, content_hash string, note string")
    found = sorted((r["note"], r["body"] and json.loads(r["body"])["v"], r["fault"]) for r in store.fetched(wanted, spark.read.parquet(path), 16).collect() if r["note"] != "i")
    assert found == [("a", 10, None), ("a", 10, None), ("b", 10, None), ("c", None, "changed"), ("d", 14, None), ("e", None, "broken"), ("f", None, "broken"), ("g", None, "missing"), ("h", None, "missing")]


def test_few_artifacts_read_few_folders(spark, tmp_path):
    path, asked = f"{tmp_path}/store", f"{tmp_path}/asked"
    held = artifacts(spark.range(500).withColumn("v", F.lit(1)), "id", "run", ["id"]).withColumn("kind", F.lit("run"))
    store.put(held, path, 16)
    spark.range(500).select(F.lit("run").alias("kind"), "id", F.lit(None).cast("string").alias("content_hash")).write.parquet(asked)
    df = store.fetched(spark.read.parquet(asked).where("id = 77"), spark.read.parquet(path), 16)
    assert df.first()["fault"] is None
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()


START = datetime(2024, 1, 1)
HINT = "profile_id string, hint_id string, at timestamp, output_type string, terms array<string>"


def hint(profile, name, minute, *terms):
    return (profile, name, START + timedelta(minutes=minute), "table", list(terms))


def test_hints_of_candidates(spark):
    window = "struct<start:int,end:int>"
    rows = [("p", "c", START, "table", ["a b", " ", None, *[f"t{i}" for i in range(60)]], None, [None, (1, 2), *[(i, i) for i in range(9)]]), ("p", "d", START, None, None, (5, 6), None)]
    one, two = hints.hints_of(spark.createDataFrame(rows, f"profile_id string, candidate_id string, confirmed_at timestamp, type string, matched_terms array<string>, row_window {window}, matched_windows array<{window}>")).orderBy("hint_id").collect()
    assert len(one["terms"]) == 48 and one["terms"][0] == "a b" and tuple(one["window"]) == (1, 2) and len(one["windows"]) == 4
    assert two["terms"] == [] and tuple(two["window"]) == (5, 6) and two["windows"] is None


def plain_profiles(rows):
    out = {}
    for p in {r[0] for r in rows}:
        latest = {}
        for r in rows:
            if r[0] == p and r[1] is not None and (r[1] not in latest or latest[r[1]][2] < r[2]):
                latest[r[1]] = r
        kept = sorted(latest.values(), key=lambda r: (r[2], r[1]))[-8:]
        if kept:
            out[p] = ([r[1] for r in kept], list(dict.fromkeys(t for r in kept for t in r[4])))
    return out


def test_late_and_repeated_hints_in_a_stream(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for _ in range(150):
        n, minute = r.randrange(40), r.randrange(90)
        rows.append(hint(r.choice(["p", "p", "q"]), f"h{n:02}", minute, f"word{n}-{minute}", f"also{n % 5}"))
    # one at one time only, or what equal times say would hang on the order
    rows = list({(x[0], x[1], x[2]): x for x in rows}.values())
    rows += [hint("s", "only", 3), hint("s", None, 4)]
    r.shuffle(rows)
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    latest = {}

    def note(batch, _):
        for x in batch.collect():
            latest[x["profile_id"]] = (x["hint_ids"], x["terms"])

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (rows[:60], rows[60:110], rows[30:80], rows[110:]):
            spark.createDataFrame(part, HINT).coalesce(2).write.mode("append").parquet(source)
            stream = hints.profile_updates(spark.readStream.schema(HINT).parquet(source))
            query = stream.writeStream.foreachBatch(note).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.set(name, before)
    want = plain_profiles(rows)
    assert latest == want
    at_once = {x["profile_id"]: (x["hint_ids"], x["terms"]) for x in hints.profiles(spark.createDataFrame(rows + rows[:50], HINT)).collect()}
    assert at_once == want
