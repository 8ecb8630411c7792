"""Sorting, ranking, top-k and reshaping (T01-T09) plus exact global ranks.

A window without ``partitionBy`` (or partitioned by a hot key) runs in one
task. ``bucketed_rank`` gives the same exact rank while spreading the work:
rows are bucketed by a prefix of their sort key, bucket sizes are aggregated
(a small table), prefix offsets come from a window over that small table, and
the final rank is ``offset + rank inside the bucket``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, keys: list[str], order_col: str, tie_col: str,
                  bucket: Column, rank_col: str = "rank") -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order_col, tie_col)``.

    ``bucket`` must be monotone in ``order_col`` (e.g. a prefix of it), so the
    order of buckets agrees with the row order. Work is split over
    ``keys x buckets`` groups; a key holding a third of the rows is spread over
    all its buckets.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(*keys).orderBy("_bucket") if keys else Window.orderBy("_bucket")
    # The offsets table has one row per (key, bucket): bounded by the bucket
    # count times the number of keys; AQE broadcasts it from measured size.
    offsets = sizes.withColumn("_off", F.sum("_n").over(wk) - F.col("_n")).drop("_n")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order_col, tie_col)
    ranked = b.withColumn("_r", F.row_number().over(inner))
    return (ranked.join(offsets, [*keys, "_bucket"])
            .withColumn(rank_col, F.col("_off") + F.col("_r"))
            .drop("_bucket", "_off", "_r"))


# monotonically_increasing_id(): row inside the partition in the low 33 bits.
_ROW_BITS = 33


def ordered_index(df: DataFrame, order: list[Column], out_col: str = "idx") -> DataFrame:
    """0-based position of every row in ``order``, without a single-task window
    and whatever the values' distribution: rows are range-partitioned and sorted
    on bounds from the data, a row's place comes from its partition and its
    place inside it, and the partitions' sizes (one row each) give the offsets.

    Range bounds are sampled anew for every job, so the ranged rows are
    checkpointed (a reliable checkpoint, so one job runs here)."""
    from ..session import cut_lineage
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _ROW_BITS)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition.
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    row = F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)
    return (ranged.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(out_col, F.col("_off") + row).drop("_p", "_m", "_off"))


def global_index(df: DataFrame, order_cols: list[str], out_col: str = "idx") -> DataFrame:
    """Consecutive 0-based index in the order of the columns (``ordered_index``)."""
    return ordered_index(df, [F.col(c) for c in order_cols], out_col)


def ranked_probabilities(probs: Column, classes: list[str]) -> Column:
    """``array<struct<label, p>>`` sorted by descending p; ties keep class order."""
    labelled = F.transform(probs, lambda p, i: F.struct(
        (-p).alias("neg_p"), i.alias("ci"),
        F.element_at(F.array(*[F.lit(c) for c in classes]), i + 1).alias("label"), p.alias("p")))
    return F.transform(F.array_sort(labelled), lambda s: F.struct(s["label"].alias("label"), s["p"].alias("p")))


def argmax_label(probs: Column, classes: list[str]) -> Column:
    """Label of the largest probability; the first class wins ties."""
    pos = F.array_position(probs, F.array_max(probs))
    return F.element_at(F.array(*[F.lit(c) for c in classes]), pos.cast("int"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda reads it as its variable."""
    return F.get(F.transform(F.array(value), body), 0)


def softmax(scores: Column) -> Column:
    """Numerically stable softmax of an ``array<double>``. Maximum, exponentials and
    total are bound, so the work is linear in the classes; as expressions inside the
    lambdas they were computed again per element."""
    def over_total(ex):
        total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
        return _bound(total, lambda t: F.transform(ex, lambda x: x / t))

    return _bound(F.array_max(scores), lambda m: _bound(F.transform(scores, lambda x: F.exp(x - m)), over_total))


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group (k is the feature, not a cap on the data)."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def top_k_exact(df: DataFrame, k: int, value_col: str, tie_col: str) -> DataFrame:
    """Exact top-k rows by ``value_col`` descending, ties by ``tie_col``
    ascending, without funnelling ``partitions x k`` rows into one task.

    A histogram of the values (one row per distinct value) gives the cut
    value T: every row above T is kept, and among the rows equal to T the
    first ``k - (rows above T)`` in ``tie_col`` order are kept, numbered with
    the distributed ``global_index``. All of it stays lazy (scalar subqueries).
    """
    hist = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("_n"))
    # One row per distinct value. Frequencies repeat: d distinct ones need at
    # least d^2 / 2 occurrences, so this table stays near the root of the corpus.
    cum = hist.withColumn("_cum", F.sum("_n").over(
        Window.orderBy(F.desc(value_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = cum.where(F.col("_cum") >= k).agg(F.max(value_col).alias("t"), F.max_by(F.col("_cum") - F.col("_n"),
                                                                               F.col(value_col)).alias("above"))
    t = cut.select("t").scalar()
    above = cut.select("above").scalar()
    # Fewer than k rows in total: the cut is NULL and every row is kept.
    sure = df.where(t.isNull() | (F.col(value_col) > t))
    ties = global_index(df.where(F.col(value_col) == t), [tie_col], "_i")
    chosen = ties.where(F.col("_i") < F.lit(k) - above).drop("_i")
    return sure.unionByName(chosen)
