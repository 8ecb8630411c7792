"""Evaluation metrics as aggregations.

Input: pairs ``(y, p)`` (truth, prediction), optionally with group columns
(one evaluation per group, e.g. per run or per fold). Everything is derived
from the confusion counts ``groupBy(group, y, p).count()``, which is at most
``groups x k^2`` rows after map-side partial aggregation, so the pairs are
scanned once and never shuffled whole.

Semantics: per-class precision / recall / F1 / support for each *configured*
class, 0 on an empty denominator; macro and weighted F1 over the classes
*observed* in truth or prediction; accuracy over all pairs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _div0(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion_counts(pairs: DataFrame, y: str = "y", p: str = "p", group=()) -> DataFrame:
    """``(group, y, p, n)``."""
    return pairs.groupBy(*group, y, p).agg(F.count(F.lit(1)).alias("n"))


def label_stats(conf: DataFrame, y: str = "y", p: str = "p", group=()) -> DataFrame:
    """Observed labels: ``(group, label, tp, n_true, n_pred)`` without a join:
    each confusion cell contributes to its truth label and its predicted label."""
    both = F.array(
        F.struct(F.col(y).alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("pr"),
                 F.when(F.col(y) == F.col(p), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col(p).alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("pr"),
                 F.lit(0).cast("long").alias("tp")))
    e = conf.select(*group, F.inline(both))
    return e.groupBy(*group, "label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_true"),
                                          F.sum("pr").alias("n_pred"))


def with_prf(stats: DataFrame) -> DataFrame:
    prec = _div0(F.col("tp"), F.col("n_pred"))
    rec = _div0(F.col("tp"), F.col("n_true"))
    f1 = _div0(2.0 * F.col("tp"), F.col("n_true") + F.col("n_pred"))
    return stats.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", f1)


def per_class_report(pairs: DataFrame, classes: list[str], y: str = "y", p: str = "p", group=()) -> DataFrame:
    """One row per configured class (and group):
    ``(group, label, precision, recall, f1, support)``.

    One conditional aggregation gives ``3k`` counters per group, then
    ``stack`` turns them into k rows: configured classes that never occur get
    zeros, and no class x group cross product is built.
    """
    conf = confusion_counts(pairs, y, p, group)
    aggs = []
    for i, c in enumerate(classes):
        aggs += [F.sum(F.when((F.col(y) == c) & (F.col(p) == c), F.col("n")).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(F.col(y) == c, F.col("n")).otherwise(0)).alias(f"t{i}"),
                 F.sum(F.when(F.col(p) == c, F.col("n")).otherwise(0)).alias(f"p{i}")]
    wide = conf.groupBy(*group).agg(*aggs) if group else conf.agg(*aggs)
    stack = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', {i}, tp{i}, t{i}, p{i}" for i, c in enumerate(classes))
    long = wide.selectExpr(*group, f"stack({len(classes)}, {stack}) AS (label, class_idx, tp, n_true, n_pred)")
    return with_prf(long).select(*group, "label", "class_idx", "precision", "recall", "f1",
                                 F.col("n_true").cast("long").alias("support"))


def accuracy(pairs: DataFrame, y: str = "y", p: str = "p", group=()) -> DataFrame:
    """A04."""
    a = F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy")
    return pairs.groupBy(*group).agg(a) if group else pairs.agg(a)


def summary_metrics(pairs: DataFrame, y: str = "y", p: str = "p", group=()) -> DataFrame:
    """``(group, n, accuracy, macro_f1, weighted_f1)``; F1 averages
    run over the observed classes."""
    conf = confusion_counts(pairs, y, p, group)
    st = with_prf(label_stats(conf, y, p, group))
    agg = [F.avg("f1").alias("macro_f1"),
           _div0(F.sum(F.col("f1") * F.col("n_true")), F.sum("n_true")).alias("weighted_f1"),
           F.sum("tp").alias("_tp"), F.sum("n_true").alias("n")]
    s = st.groupBy(*group).agg(*agg) if group else st.agg(*agg)
    return s.select(*group, F.col("n").cast("long").alias("n"),
                    _div0(F.col("_tp"), F.col("n")).alias("accuracy"), "macro_f1", "weighted_f1")


def all_metrics(pairs: DataFrame, classes: list[str], y: str = "y", p: str = "p", group=(),
                digits: int | None = 4) -> DataFrame:
    """A14 (+A10): one row per group with the nested per-class map.

    ``par_classe: map<label, struct<precision, rappel, f1, support>>``.
    """
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    rep = per_class_report(pairs, classes, y, p, group)
    entry = F.struct(r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("rappel"),
                     r(F.col("f1")).alias("f1"), F.col("support"))
    ordered = F.array_sort(F.collect_list(F.struct("class_idx", "label", entry.alias("m"))))
    as_map = F.map_from_entries(F.transform(ordered, lambda s: F.struct(s["label"], s["m"])))
    per = (rep.groupBy(*group) if group else rep.groupBy()).agg(as_map.alias("par_classe"))
    summ = summary_metrics(pairs, y, p, group).select(
        *group, r(F.col("accuracy")).alias("accuracy"), r(F.col("macro_f1")).alias("macro_f1"),
        r(F.col("weighted_f1")).alias("weighted_f1"))
    if group:
        return summ.join(per, list(group))
    # Both sides are single-row aggregates: join them on a constant key.
    return summ.withColumn("_k", F.lit(1)).join(per.withColumn("_k", F.lit(1)), "_k").drop("_k")


def confusion_matrix(pairs: DataFrame, classes: list[str], y: str = "y", p: str = "p",
                     prefix: str = "p_") -> DataFrame:
    """One row per configured true class, one column per predicted class
    (class order); pairs outside the list are dropped; missing cells are 0."""
    conf = confusion_counts(pairs, y, p)
    cells = [F.sum(F.when((F.col(y) == a) & (F.col(p) == b), F.col("n")).otherwise(0)).cast("long")
             .alias(f"c{i}_{j}") for i, a in enumerate(classes) for j, b in enumerate(classes)]
    wide = conf.agg(*cells)
    rows = [F.struct(F.lit(a).alias("label"), F.lit(i).alias("class_idx"),
                     *[F.col(f"c{i}_{j}").alias(f"{prefix}{b}") for j, b in enumerate(classes)])
            for i, a in enumerate(classes)]
    return wide.select(F.inline(F.array(*rows)))


def normalized_confusion(cm: DataFrame, classes: list[str], prefix: str = "p_") -> DataFrame:
    """Each row divided by its sum; an empty row is NULL (0/0)."""
    cols = [F.col(f"`{prefix}{c}`") for c in classes]
    total = sum(cols[1:], cols[0])
    return cm.select("label", "class_idx", *[F.try_divide(c.cast("double"), total).alias(f"{prefix}{n}")
                                             for c, n in zip(cols, classes)])


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                         .alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach A03 weights as a ``weightCol`` (one row per class; AQE picks a
    broadcast join from its measured size)."""
    return df.join(class_weights(df, label).select(label, F.col("weight").alias(out)), label)


def cv_summary(scores: DataFrame, score: str = "score", fold: str = "fold", group=()) -> DataFrame:
    """Mean, population std and the ordered fold list."""
    agg = [F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
           F.transform(F.array_sort(F.collect_list(F.struct(F.col(fold), F.col(score)))),
                       lambda s: s[score]).alias("fold_scores")]
    return scores.groupBy(*group).agg(*agg) if group else scores.agg(*agg)


def split_sizes(split_df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split plus a total row (``split`` NULL) via rollup."""
    return split_df.rollup(split_col).agg(F.count(F.lit(1)).alias("n"))
