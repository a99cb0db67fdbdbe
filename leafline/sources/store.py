"""A store of JSON artifacts by kind and shard, of which a join reads only what it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders a kind is spread over: a store's own number, given again when it is read.
SHARDS = 64


def shard(key: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.crc32(key.cast("string")), F.lit(shards)).cast("int")


def put(artifacts: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Add artifacts (``kind, id, body, content_hash``) below ``path``, a folder a kind and shard."""
    held = artifacts.select("kind", shard(F.col("id"), shards).alias("shard"), F.col("id").cast("string").alias("id"), "body", "content_hash")
    # the rows of a folder in as many tasks as it has rows for, so a common kind is not one task
    held.repartition("kind", "shard", F.pmod(F.crc32(F.col("content_hash").cast("string")), F.lit(4))).write.mode("append").partitionBy("kind", "shard").parquet(path)


def fetched(wanted: DataFrame, store: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Each wanted artifact, or why it is not there: ``wanted`` with ``body`` and ``fault``.

    ``wanted`` has ``kind, id`` and ``content_hash``, null for any. ``fault`` is
    ``missing``, ``changed`` (only other contents are there), ``broken`` (the body
    is no JSON or not what its hash says), or null; the body is null with a
    fault. Of artifacts of one id without a hash asked for, the one whose hash is the smallest counts, sound ones first.
    The shard is part of the join, so where the wanted ones are few enough to be
    sent around only the folders that hold some are read.
    """
    named = wanted.select("kind", F.col("id").cast("string").alias("id"), F.col("content_hash").alias("_hash")).distinct()
    keyed = named.withColumn("shard", shard(F.col("id"), shards))
    met = keyed.join(store.select("kind", "shard", "id", "body", F.col("content_hash").alias("_kept")), ["kind", "shard", "id"], "left")
    sound = (F.sha2("body", 256) == F.col("_kept")) & F.try_parse_json("body").isNotNull()
    same = F.col("_hash").isNull() | (F.col("_hash") == F.col("_kept"))
    rank = F.when(F.col("_kept").isNull() & F.col("body").isNull(), 3).when(~same, 2).when(sound, 0).otherwise(1)
    # the rank and hash decide which copy counts; bodies travel once, with the winner
    best = met.withColumn("_rank", rank).groupBy("kind", "id", "_hash").agg(F.min_by(F.struct("_rank", F.when(F.col("_rank") == 0, F.col("body")).alias("body")), F.struct("_rank", "_kept")).alias("x"))
    fault = F.when(F.col("x._rank") == 1, "broken").when(F.col("x._rank") == 2, "changed").when(F.col("x._rank") == 3, "missing")
    found = best.select(F.col("kind").alias("_k"), F.col("id").alias("_i"), F.col("_hash").alias("_h"), F.col("x.body").alias("body"), fault.alias("fault"))
    a = wanted.drop("body", "fault")
    return a.join(found, (a["kind"] == F.col("_k")) & (a["id"].cast("string") == F.col("_i")) & a["content_hash"].eqNullSafe(F.col("_h")), "left").drop("_k", "_i", "_h")
