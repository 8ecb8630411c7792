"""Token counts as delta-maintained rollups.

Every change of a document is a signed row: an insert adds its count, a delete
takes the same count away, a revised count is a delete of the old and an insert
of the new. A batch of changes is reduced to one row per (source, language,
tokenizer version) - partial sums before the shuffle, so a hot source is a few
rows a task - and committed under its batch id. Totals are sums over the
committed batches, so no document is read again.

A commit is idempotent: a batch writes to a folder of its own and is renamed to
``batch=<id>`` at the end. A batch id that is already there is left as it is,
and an attempt that dies leaves a folder that no reader opens.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def inserts(counts: DataFrame) -> DataFrame:
    """Changes of ``counts(source, lang, tokenizer, n_tokens)``: null counts are 0."""
    return counts.select(*KEYS, F.lit(1).alias("sign"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return inserts(counts).withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Rollup in a folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch_id: int) -> bool:
        return self._fs.exists(self._path(f"{self.root}/batch={int(batch_id)}"))

    def commit(self, batch_id: int, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if its id is committed already
        (the changes are then ignored, whatever they hold). An empty batch is
        a commit like any other."""
        if self.committed(batch_id):
            return False
        own = f"{self.root}/_attempt-{uuid.uuid4().hex}"
        (changes.groupBy(*KEYS).agg(F.sum("sign").cast("bigint").alias("docs"),
                                    F.sum(F.col("sign") * F.col("n_tokens")).cast("bigint").alias("tokens"))
         .write.parquet(own))
        target = self._path(f"{self.root}/batch={int(batch_id)}")
        if self._fs.exists(target) or not self._fs.rename(self._path(own), target):
            self._fs.delete(self._path(own), True)
            return False
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)``; keys whose documents are
        all gone are left out. Null keys are keys of their own."""
        batches = [s.getPath().toString() for s in self._fs.listStatus(self._path(self.root))
                   if s.getPath().getName().startswith("batch=")] if self._fs.exists(self._path(self.root)) else []
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        parts = self.spark.read.schema(SCHEMA).parquet(*batches)
        return (parts.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs <> 0 or tokens <> 0"))
