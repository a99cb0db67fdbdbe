"""Lineage cuts and connected components, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a few numbers that one task takes without a thought.
FEW = 500_000


def narrow(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, a written table of a few numbers a row, in one partition where that holds no more than ``most`` rows: what follows needs no exchange."""
    return df.coalesce(1) if df.count() <= most else df


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a temporary folder takes its place if driver and
    executors are one process; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="leafline-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python workers ``rows`` at a time, where the session is still set to Spark's ten thousand: a batch is held several times over on its way."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Parquet tables of one run in the shared folder.

    Each is a lineage cut that survives lost executors; ``drop`` takes those
    away that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}", []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.made)}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((found, path))
        return found

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that ``put`` gave."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for found, name in self.made:
            if any(found is x for x in frames):
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)


class Sent:
    """A value that all tasks read, sent with the code of its class: executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        self.held, self.own = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"held": self.held, "own": None}

    @property
    def value(self):
        if self.own is None:
            self.own = cloudpickle.loads(self.held.value)
        return self.own


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until none of ``columns`` has it, in whatever case."""
    taken = {x.lower() for x in columns}
    while name.lower() in taken:
        name += "_"
    return name


def plus(schema: T.StructType, **more: T.DataType) -> T.StructType:
    """``schema`` with further nullable fields; a new object, since ``add`` would alter the one a DataFrame holds."""
    return T.StructType([*schema.fields, *[T.StructField(name, kind) for name, kind in more.items()]])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable from each vertex.

    ``edges`` has long columns ``a`` and ``b``. Returns ``id, component`` for
    every vertex that has an edge. Alternates the large-star and the small-star
    step until the edges stop changing; either step is a grouped minimum and a
    join, so a vertex of very high degree is never gathered anywhere. Chains of
    length n take about log n rounds. Raises if ``rounds`` don't suffice.
    """
    tables = Tables(edges.sparkSession)

    def settled(found: DataFrame, parts: int | None) -> tuple[DataFrame, tuple, int]:
        """Distinct edges, kept in as few files as they need, with a checksum that tells whether they changed."""
        found = found.where("u <> v").distinct()
        found = tables.put(found if parts is None else found.coalesce(parts))
        now = tuple(found.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        return found, now, max(1, -(-now[0] // FEW))

    star, last, parts = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None)
    for _ in range(rounds):
        before, star = star, star.coalesce(parts)
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        star, now, parts = settled(small.select("e.u", "e.v"), parts)
        tables.drop(before)
        if now == last:
            roots = star.select(F.col("v").alias("id"), F.col("v").alias("component"))
            return star.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
