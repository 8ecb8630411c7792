"""Flagship query: top terms per class by mean TF-IDF.

documents -> matrices -> rendered text -> word 1-2 grams -> TF-IDF (sklearn
semantics: min_df 2, 15,000 terms, sub-linear tf, smoothed idf, L2) -> mean
weight per (label, term) over the documents of the label -> top 10 per label.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import render_text
from ..operators.ranking import top_k_per_group
from ..operators.tfidf import TfidfParams, tfidf_long
from . import oracle as O
from .adapters import documents_as_tables

TOP_K = 10


def top_terms_per_label(tables: DataFrame, params: TfidfParams | None = None, k: int = TOP_K) -> DataFrame:
    params = params or TfidfParams()
    docs = tables.select("id", "label", render_text("table_data", max_content_cells=None).alias("text"))
    long = tfidf_long(docs, params, carry=["label"])
    n_per_label = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))
    # (label, term) sums: at most labels x vocabulary rows after partial aggregation.
    sums = long.groupBy("label", "term").agg(F.sum("weight").alias("s"))
    mean = sums.join(n_per_label, "label").select(
        "label", "term", (F.col("s") / F.col("n_docs")).alias("mean_tfidf"))
    top = top_k_per_group(mean, ["label"], [F.desc("mean_tfidf"), F.asc("term")], k)
    return top.select("label", F.col("rank").cast("long").alias("rank"), "term",
                      F.round("mean_tfidf", 6).alias("mean_tfidf"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_terms_per_label(documents_as_tables(spark, sf_dir))


def oracle() -> str:
    ctes = [
        f"docs AS (SELECT id, label, {O.render('table_data', max_content_cells=None)} AS text FROM tables)",
        *O.tfidf_ctes("docs", carry="label"),
        "nlab AS (SELECT label, count(*) AS n_docs FROM docs GROUP BY label)",
        "mean AS (SELECT t.label, t.term, sum(t.weight) / any_value(n.n_docs) AS mean_tfidf "
        "FROM tfidf t JOIN nlab n ON t.label = n.label GROUP BY t.label, t.term)",
        "ranked AS (SELECT label, term, mean_tfidf, row_number() OVER "
        "(PARTITION BY label ORDER BY mean_tfidf DESC, term) AS rank FROM mean)",
    ]
    return (O.with_tables(*ctes) +
            f"SELECT label, CAST(rank AS BIGINT) AS rank, term, round(mean_tfidf, 6) AS mean_tfidf "
            f"FROM ranked WHERE rank <= {TOP_K}")
