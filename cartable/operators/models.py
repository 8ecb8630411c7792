"""Classifiers.

* Spark ML's logistic regression. The calibrated linear SVM is in ``svm``, boosted
  trees are in ``boosting``, random forests in ``forest``.
* Complement Naive Bayes written as two aggregations over the long-form
  features (no vectors, SQL-checkable), including the weight normalisation
  Spark's own ``NaiveBayes`` lacks.
* Votes: soft (mean of probability arrays) and hard (most votes, ties by
  class order).

All probability outputs are ``array<double>`` in class order (classes sorted
alphabetically, as the label encoder orders them).
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import argmax_label, softmax

MODEL_TYPES = ("logistic_regression", "linear_svc", "random_forest", "gradient_boosting",
               "complement_nb", "lightgbm", "xgboost", "ensemble_vote")
BOOSTED = ("gradient_boosting", "lightgbm", "xgboost")


# ----------------------------------------------------------- helpers
def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def normalize_rows(arr: Column) -> Column:
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    k = F.size(arr)
    return F.transform(arr, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / k))


def mean_arrays(arrs: list[Column]) -> Column:
    """Element-wise mean of equally long ``array<double>`` columns."""
    acc = arrs[0]
    for a in arrs[1:]:
        acc = F.zip_with(acc, a, lambda x, y: x + y)
    n = float(len(arrs))
    return F.transform(acc, lambda x: x / n)


def hard_vote(votes: DataFrame, classes: list[str], id_col: str = "id", label: str = "label") -> DataFrame:
    """Most frequent label per id; ties go to the first class in order."""
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    c = votes.groupBy(id_col, label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(id_col).orderBy(F.desc("_n"), pos)
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(id_col, label)


# ---------------------------------------------------- Spark ML models
@dataclass
class ModelSpec:
    """A model type plus its (reference-style) parameters."""
    type: str
    params: dict


def build_estimator(spec: ModelSpec, weight_sum: float, features: str = "features", label: str = "label_idx",
                    weight: str | None = "weight"):
    """The Spark ML estimator for a model spec.

    ``C`` (inverse regularisation on the summed loss) becomes
    ``regParam = 1 / (C * weight_sum)``, where ``weight_sum`` is the sum of the
    weights of the rows this estimator is fitted on.
    """
    p = dict(spec.params or {})
    balanced = p.get("class_weight") == "balanced"
    wcol = weight if balanced else None
    kw = {"featuresCol": features, "labelCol": label}
    if spec.type == "logistic_regression":
        reg = 1.0 / (float(p.get("C", 1.0)) * max(weight_sum, 1.0))
        est = LogisticRegression(family="multinomial", regParam=reg, elasticNetParam=0.0,
                                 standardization=False, maxIter=int(p.get("max_iter", 100)), **kw)
        return est.setWeightCol(wcol) if wcol else est
    raise ValueError(f"unknown model type {spec.type!r}; available: {list(MODEL_TYPES)}")


def sized_partitions(cached: DataFrame, target_bytes: int = 32 << 20) -> DataFrame:
    """A materialised cached frame in as many partitions as its bytes need.

    Tree training starts several jobs per level, so a task over a few rows costs
    more to start than to run. Coalescing only joins partitions: no shuffle, and
    a large frame keeps the partitions it has."""
    size = int(str(cached._jdf.queryExecution().withCachedData().stats().sizeInBytes()))
    return cached.coalesce(max(1, math.ceil(size / target_bytes)))


def predict_proba(model, df: DataFrame, spec: ModelSpec, out: str = "proba") -> DataFrame:
    """Adds ``out: array<double>`` (class order) to ``df``; Spark's own output
    columns do not stay, so models can be chained on one frame."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array(F.col("probability"))).drop("rawPrediction", "probability", "prediction")


# ----------------------------------------------------------------- votes
def vote_labels(probas: list[Column], classes: list[str]) -> Column:
    """M10 on one row: most frequent arg-max class; ties go to class order."""
    won = [argmax_label(p, classes) for p in probas]
    counts = [sum((F.when(w == c, 1.0).otherwise(0.0) for w in won[1:]), F.when(won[0] == c, 1.0).otherwise(0.0)) for c in classes]
    return argmax_label(F.array(*counts), classes)


# ------------------------------------------------ Complement Naive Bayes
def fit_complement_nb(long: DataFrame, classes: list[str], alpha: float = 1.0, norm: bool = False,
                      label: str = "label", idx: str = "idx", value: str = "weight") -> DataFrame:
    """Model table ``(idx, flp: array<double>)``, one row per feature; cached, the
    caller releases it.

    ``comp[c,t] = all[t] + alpha - count[c,t]``; ``logged = ln(comp / sum_t comp)``;
    weights are ``-logged`` or, with ``norm``, ``logged / sum_t logged``.
    The per-class sums are scalar aggregates over the (bounded) feature table.
    """
    k = len(classes)
    wide = long.groupBy(idx).pivot(label, classes).agg(F.sum(value)).na.fill(0.0)
    cnt = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in classes]
    total = sum(cnt[1:], cnt[0])
    # One row per feature (bounded by the vocabulary): cached, because the
    # per-class sums below and the final table both read it.
    comp = wide.select(idx, *[(total + F.lit(float(alpha)) - cnt[i]).alias(f"c{i}") for i in range(k)]).cache()
    sums = comp.agg(*[F.sum(f"c{i}").alias(f"s{i}") for i in range(k)]).first()  # k numbers
    logged = comp.select(idx, *[F.log(F.col(f"c{i}") / F.lit(float(sums[f"s{i}"]))).alias(f"l{i}")
                                for i in range(k)])
    if norm:
        lsum = logged.agg(*[F.sum(f"l{i}").alias(f"t{i}") for i in range(k)]).first()  # k numbers
        flp = [F.col(f"l{i}") / F.lit(float(lsum[f"t{i}"])) for i in range(k)]
    else:
        flp = [-F.col(f"l{i}") for i in range(k)]
    model = logged.select(idx, F.array(*flp).alias("flp")).cache()
    model.count()
    comp.unpersist()
    return model


def predict_complement_nb(long: DataFrame, model: DataFrame, classes: list[str], ids: DataFrame,
                          id_col: str = "id", idx: str = "idx", value: str = "weight",
                          bounded: bool = False) -> DataFrame:
    """Joint log-likelihood ``X @ flp`` per class, arg-max label and softmax
    probabilities. The model has one row per feature: it is broadcast when the
    caller has counted them (``bounded``), otherwise AQE decides from its measured size.
    Documents without features score 0 for every class."""
    k = len(classes)
    m = F.broadcast(model) if bounded else model
    j = long.select(id_col, idx, value).join(m, idx)
    jll = j.groupBy(id_col).agg(*[F.sum(F.col(value) * F.col("flp")[i]).alias(f"j{i}") for i in range(k)])
    allrows = ids.select(id_col).join(jll, id_col, "left")
    arr = F.array(*[F.coalesce(F.col(f"j{i}"), F.lit(0.0)) for i in range(k)])
    scored = allrows.select(id_col, arr.alias("jll"))
    return scored.select(id_col, "jll", argmax_label(F.col("jll"), classes).alias("prediction"),
                         softmax(F.col("jll")).alias("proba"))


# ----------------------------------------------------- batched scoring
def batch_scorer(make_predict_fn, input_size: int, batch_size: int = 32):
    """Wrap a caller-supplied model as an Arrow-batched UDF producing
    ``array<float>`` scores (``batch_size`` rows per call)."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType
    return predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size,
                             input_tensor_shapes=[[int(input_size)]])
