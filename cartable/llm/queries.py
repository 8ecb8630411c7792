"""One query per corpus operator, with production parameters and whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, embed, html, license, minhash, quality, records, repair, rollup, shard, toxicity, trie
from .common import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

END_ID = 2  # appended to each document's ids


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


@_query
def op3_pca_tiled_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


@_query
def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.hilbert_shards(table(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], shards=16)


@_query
def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"), license.known(spark))


ORACLES["op5_license_digests"] = license.oracle()


@_query
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Scratch(spark, "op6").path("records")
    ids = records.token_records(table(spark, sf_dir, "documents"), vocabulary(), END_ID, out)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches over all documents: insert under one tokenizer version,
    insert under a second, revise the English counts of the first, withdraw two
    sources, and two batches delivered again."""
    text = F.coalesce("text", F.lit(""))
    scratch = Scratch(spark, "op7")
    counts = scratch.write(table(spark, sf_dir, "documents").select(
        "source", "lang", F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).alias("words"),
        F.size(F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")).alias("runs"),
        F.ceil(F.octet_length(text) / 4).alias("quarters")), "counts")
    count = lambda version, column: counts.select(
        "source", "lang", F.lit(version).alias("tokenizer"), F.col(column).alias("n_tokens"))
    english, gone = F.col("lang") == "en", F.col("source").isin("src3", "src7")
    first, second = count("words-1", "words"), count("quarters-1", "quarters")
    now = first.where(~english | english.isNull()).unionByName(count("words-1", "runs").where(english)).unionByName(second)
    totals = rollup.Rollup(spark, scratch.path("rollup"))
    totals.commit(1, rollup.inserts(first))
    totals.commit(2, rollup.inserts(second))
    totals.commit(3, rollup.revisions(first.where(english), count("words-1", "runs").where(english)))
    totals.commit(2, rollup.inserts(second))
    totals.commit(4, rollup.deletes(now.where(gone)))
    totals.commit(3, rollup.revisions(first.where(english), count("words-1", "runs").where(english)))
    return totals.totals()


ORACLES["op7_token_rollup"] = r"""
WITH counts AS (
  SELECT source, lang,
    CASE WHEN lang = 'en' THEN len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'))
         ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS words,
    CAST(ceil(strlen(coalesce(text, '')) / 4.0) AS BIGINT) AS quarters
  FROM documents WHERE source IS NULL OR source NOT IN ('src3', 'src7')),
flat AS (SELECT source, lang, 'words-1' AS tokenizer, words AS n FROM counts
  UNION ALL SELECT source, lang, 'quarters-1', quarters FROM counts)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM flat GROUP BY source, lang, tokenizer"""


@_query
def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op9_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@_query
def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), path=vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.repaired_digests(repair.repair(rows, F.col("present")))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op12")
    return trie.prefix_trie(trie.rebuilt(trie.sequences(table(spark, sf_dir, "conversations"), scratch)), scratch)


ORACLES["op12_prefix_trie"] = trie.ORACLE


@_query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
