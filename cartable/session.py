"""Spark session helpers.

On a cluster the session is created by the platform; ``get_spark`` only fills
in settings that are unset, so cluster-level values (shuffle partitions,
checkpoint directory, ...) always win.
"""
from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Settings this library relies on. They are applied only when the running
# session does not define them already.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app_name: str = "cartable",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one for tests / benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    local = (master or "").startswith("local")
    conf = dict(DEFAULT_CONF)
    if local:
        conf.update({
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("CARTABLE_DRIVER_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": str(shuffle_partitions or 8),
        })
    elif shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS / object-store) folder there. Only when the
    setting is absent -- local tests and benches -- is a scratch folder made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="cartable-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


class SharedTables:
    """Tables written to a folder of their own under the shared folder: they cut
    lineage like a checkpoint, and are deleted when no later step reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._written = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self._written += 1
        path = f"{self.root}/{self._written:04d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shared_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let tasks import this package although their workers may have been started
    from another folder: the driver serves an archive of its code, once."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in map(os.path.abspath, found):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="cartable-"), "cartable")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "cartable"))
    _SHIPPED.add(app)


def side_by_side(spark: SparkSession, tasks: list[Callable], name: str, at_once: int = 4) -> list:
    """Results of independent driver tasks whose Spark jobs overlap. Each runs in a
    thread that inherits the caller's properties, with a job group and a scheduler
    pool of its own (pools share the cores under ``spark.scheduler.mode=FAIR``). The
    first error is raised once all running tasks have ended; the rest do not start."""
    sc = spark.sparkContext

    def run(i: int, task: Callable):
        sc.setJobGroup(f"{name}-{i}", f"{name} {i}")
        sc.setLocalProperty("spark.scheduler.pool", f"{name}-{i}")
        return task()

    if len(tasks) < 2 or at_once < 2:
        return [t() for t in tasks]
    with ThreadPoolExecutor(min(at_once, len(tasks))) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(run), i, t) for i, t in enumerate(tasks)]
        try:
            return [s.result() for s in started]
        except BaseException:
            for s in started:
                s.cancel()
            raise
