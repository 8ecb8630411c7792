"""Shared pieces of the corpus operators: scratch tables, order, components."""
from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir

# monotonically_increasing_id() keeps the row's place inside its partition in
# the low 33 bits and the partition in the bits above.
_ROW_BITS = 33


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package where they would not find it: tasks
    import it, and a session may have been started from another folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    seen = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in (os.path.abspath(p) for p in seen):
        return
    # The driver serves the archive to the executors.
    base = os.path.join(tempfile.mkdtemp(prefix="cartable-"), "cartable")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "cartable"))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HELD: dict = {}


def held(key, make):
    """One object that a Python worker keeps between its tasks. Workers are used again
    by other operators, so only the object asked for last stays in memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches, rows: int = 512):
    """Arrow batches of at most ``rows`` rows, for operators that make Python strings
    of whole texts. What an earlier operator left in this worker is let go first."""
    import pyarrow as pa
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session."""
    return spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)


class Scratch:
    """Written tables in the shared folder. They cut lineage (a lost executor
    costs a reread, not the whole history) and pin values that must not be
    computed twice, such as sampled range bounds."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            p = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def ordered_index(df: DataFrame, keys: list, scratch: Scratch, out: str = "idx") -> DataFrame:
    """0-based position of every row in the order of ``keys`` (names).

    Rows are range-partitioned and sorted; the place inside a partition comes
    from ``monotonically_increasing_id`` and the partition's offset from the
    counts of the partitions before it (one row per partition). No window over
    data, so a hot key is split like any other run of rows. The ranged rows
    are written once because range bounds are sampled anew for every job.
    """
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_m", F.monotonically_increasing_id()))
    ranged = scratch.write(ranged, "ranged")
    part = F.shiftright("_m", _ROW_BITS)
    counts = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window over this table is bounded by their number.
    offsets = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    row = F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)
    return (ranged.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(out, F.col("_off") + row).drop("_p", "_m", "_off"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` for every end of an edge ``(a, b)``; the component
    is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014). A round
    is three shuffles of ``(node, lower neighbour)`` rows and one written table,
    which also tells whether its edges may not be stars yet, so no round is spent
    on finding that nothing changes any more. Once every node has one lower
    neighbour only pointers are left to follow: a join of those rows with themselves.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least, several, done = F.min("v").over(Window.partitionBy("u")), True, None
    while True:
        # Rows of one node meet: equal ones go, and each learns the node's least neighbour.
        d = e.repartition("u").distinct().withColumn("m", least) if several else e.withColumn("m", F.col("v"))
        # Large-star: all higher neighbours of a node go to its least neighbour.
        lower = d.where("v = m").select(F.col("u").alias("v"), F.col("m").alias("to"))
        large = scratch.write(d.join(lower, "v", "left").select(
            "u", F.coalesce("to", "v").alias("v"), F.expr("to is not null").alias("moved"),
            F.expr("v <> m").alias("several")), "edges")
        if done is not None:
            scratch.drop(done)
        moved, several = large.agg(F.max("moved"), F.max("several")).first()
        if not moved and not several:
            break
        e, done = large.select("u", "v"), large
        if several:  # Small-star: all neighbours below a node, and the node, go to the least of them.
            e = e.withColumn("m", least).select(
                F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return large.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        large.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
