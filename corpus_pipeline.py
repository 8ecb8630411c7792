"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, token ids.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns the documents that stay, with the columns of ``docs``; the
last returns token ids. Every stage works on all its predecessor kept. ``run``
writes each stage's result as Parquet in the shared folder and reads it again.

Tables are read as they are: null and empty texts pass every stage (nothing is
wrong with them), rows with a null id are never joined away, and other columns
are carried along untouched.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartable.llm import bpe, decontam, minhash, toxicity
from cartable.llm.common import Scratch, table
from cartable.llm.queries import vocabulary

SHINGLE, PERCENT = 5, 80  # near-duplicates: five-word shingles, similarity 0.8 or more


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold (map only)."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.
    Rows that repeat both id and text are copies, of which one stays."""
    found = minhash.near_duplicates(docs, SHINGLE, PERCENT)
    scratch = Scratch(spark, "pipeline")
    gone = scratch.write(found.where("not kept").select("doc_id").distinct(), "gone")
    docs = _without(docs, gone)
    twice = scratch.write(docs.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias("h"))
                          .agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id").distinct(), "twice")
    if twice.isEmpty():
        return docs
    return _without(docs, twice).unionByName(docs.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    pairs = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, Scratch(spark, "pipeline").write(pairs.select("doc_id").distinct(), "leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``: ids as little-endian unsigned
    32-bit integers, and whether decoding gives the text again."""
    out = bpe.encode_decode(docs, path=vocabulary(), check=True)
    return out.select("doc_id", "n_tokens", "ids", "round_trip")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in a written table of ids: its size on disk tells the
    planner whether to broadcast it or to shuffle."""
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("encoding", encode)]

# Min-max hashing, Levenshtein automata and BPE have no SQL form; tests/llm
# compares run() with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
