"""Adapters from the given tables to labelled matrices.

``documents`` becomes a corpus of tables: each line is a row, ``", "``
separates cells, ``lang`` is the label. ``conversations`` becomes one matrix
per conversation (``[role, text]`` rows in turn order).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How a document text is cut into a matrix.
LINE_SEP = "\n"
CELL_SEP = ", "


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def documents_as_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id LONG, table_data ARRAY<ARRAY<STRING>>, label STRING``."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.transform(F.split("text", LINE_SEP), lambda r: F.split(r, CELL_SEP)).alias("table_data"),
        F.col("lang").alias("label"),
    )


def conversation_texts(spark: SparkSession, sf_dir: str, **rendering) -> DataFrame:
    """Rendered text of every conversation, ``(id, text, n_turns)``: one matrix
    row ``[role, text]`` per turn, rendered with ``rendering`` (the parameters of
    ``preprocess_params``).

    Turns are ranked once by (turn, role, text). With a cell cap, rendering reads
    the header rows and the first ``max_content_cells`` non-blank cells, so the
    turns behind them are left out before the matrix is gathered: a turn with a
    non-blank cell gives at least one, so those ranked behind the cap among such
    turns cannot be read. A rank limit is applied per partition before the
    shuffle, so a hot conversation moves that many turns a task. Without a cap
    the feature asks for the whole conversation as one text, and all turns move.
    """
    from ..functions.render import clean_cell, preprocess_params, render_text
    params = preprocess_params(**rendering)
    cap, header = params["max_content_cells"], int(params["header_rows"])
    c = read_table(spark, sf_dir, "conversations")
    n_turns = c.groupBy("conv_id").agg(F.count(F.lit(1)).cast("long").alias("n_turns"))
    order = ["turn", "role", "text"]
    kept = c
    if cap is not None:
        blank = (clean_cell(F.col("role")) == "") & (clean_cell(F.col("text")) == "")
        by_turn = Window.partitionBy("conv_id").orderBy(*order)
        # Rank among all turns up to the header, and among the non-blank ones up
        # to the cap: both are top-k filters that Spark limits before shuffling.
        head = c.withColumn("_r", F.row_number().over(by_turn)).where(F.col("_r") <= header).drop("_r")
        full = (c.where(~blank).withColumn("_r", F.row_number().over(by_turn))
                .where(F.col("_r") <= int(cap) + header).drop("_r"))
        # A turn of the header that is not blank is in both; the tag keeps one.
        kept = head.where(blank).unionByName(full)
    rows = kept.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(*order, F.array("role", "text").alias("row")))).alias("r"))
    tables = rows.select(F.col("conv_id").alias("id"), F.transform("r", lambda s: s["row"]).alias("table_data"))
    return tables.join(n_turns.withColumnRenamed("conv_id", "id"), "id").select(
        "id", render_text("table_data", **params).alias("text"), "n_turns")


def label_pairs_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth / prediction pairs: ``labels.quality`` vs ``labels.toxic`` as strings."""
    lab = read_table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("id"),
                      F.col("quality").cast("string").alias("y"),
                      F.col("toxic").cast("string").alias("p"))


def label_pairs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth / prediction pairs from orders: status vs a priority-derived code.

    Priorities ``1``/``2`` map to ``F``, ``3`` to ``O``, ``4``/``5`` to ``P``; it is
    a deterministic stand-in for a model's output.
    """
    o = read_table(spark, sf_dir, "orders")
    pr = F.substring("o_orderpriority", 1, 1)
    pred = F.when(pr.isin("1", "2"), "F").when(pr == "3", "O").otherwise("P")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("y"), pred.alias("p"))
