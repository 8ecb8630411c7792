"""Registered model and job queries.

All train on ``documents`` as labelled matrices (label = ``lang``) with the
exact stratified split, fit features on the training rows only and score the
test rows. Complement NB is fully SQL-expressible and has a DuckDB oracle; the
others are checked on rows.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as MD
from . import jobs as J
from . import oracle as O
from .adapters import documents_as_tables, read_table
from .catalog_eval import _DOCS, split_sql_ctes
from .registry import register


def _split_docs(spark, sf, cfg):
    docs = J.split_docs(documents_as_tables(spark, sf), cfg)
    return docs.where("split = 'train'").drop("split"), docs.where("split = 'test'").drop("split")


def _fit_predict(spark, sf, name):
    cfg = J.preset(name)
    train, test = _split_docs(spark, sf, cfg)
    fitted = J.fit_model(train, cfg)
    return fitted, fitted.predict(test).join(test.select("id", "label"), "id")


def _pred_rows(pred):
    return pred.select("id", "label", "prediction", F.round(F.array_max("proba"), 6).alias("p_max"))


# ----------------------------------------------------- Complement NB
_CNB_CLASSES = ["de", "en", "es", "fr"]


def _cnb_oracle(score_rel: str | None = None, out: str = "SELECT id, label, {pred} AS prediction FROM allj",
                train: str = "split = 'train'") -> str:
    """CNB chain in SQL; ``score_rel`` is a CTE body giving ``(id, label, text)``
    to score (default: the test split), ``train`` the rows to fit on."""
    k = range(len(_CNB_CLASSES))
    tok = O.ngrams("tok", 1, 2)
    ctes = [
        _DOCS, *split_sql_ctes(),
        f"docs AS (SELECT t.id, t.label, {O.render('t.table_data')} AS text, sp.split FROM tables t JOIN sp ON t.id = sp.id)",
        f"tr AS (SELECT id, label, text FROM docs WHERE {train})",
        f"te AS ({score_rel or chr(32).join(['SELECT id, label, text FROM docs WHERE split =', chr(39) + 'test' + chr(39)])})",
        *O.tfidf_ctes("tr", prefix="a_"),
        f"b_toks AS (SELECT id, {O.word_tokens('text')} AS tok FROM te)",
        f"b_terms AS (SELECT id, unnest({tok}) AS term FROM b_toks)",
        "b_counts AS (SELECT id, term, count(*) AS tf FROM b_terms GROUP BY ALL)",
        "b_raw AS (SELECT c.id, v.idx, (1 + ln(c.tf)) * v.idf AS w FROM b_counts c JOIN a_vocab v ON c.term = v.term)",
        "b_tfidf AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM b_raw)",
        "fc AS (SELECT t.idx, " + ", ".join(
            f"sum(CASE WHEN l.label = '{c}' THEN t.weight ELSE 0 END) AS c{i}" for i, c in enumerate(_CNB_CLASSES)) +
        " FROM a_tfidf t JOIN tr l ON t.id = l.id GROUP BY t.idx)",
        "comp AS (SELECT idx, " + ", ".join(
            f"({' + '.join(f'c{j}' for j in k)}) + 0.1 - c{i} AS k{i}" for i in k) + " FROM fc)",
        "lg AS (SELECT idx, " + ", ".join(f"ln(k{i} / sum(k{i}) OVER ()) AS l{i}" for i in k) + " FROM comp)",
        "flp AS (SELECT idx, " + ", ".join(f"l{i} / sum(l{i}) OVER () AS f{i}" for i in k) + " FROM lg)",
        "jll AS (SELECT b.id, " + ", ".join(f"sum(b.weight * f.f{i}) AS j{i}" for i in k) +
        " FROM b_tfidf b JOIN flp f ON b.idx = f.idx GROUP BY b.id)",
        "allj AS (SELECT te.id, te.label, " + ", ".join(f"coalesce(j{i}, 0) AS j{i}" for i in k) +
        " FROM te LEFT JOIN jll ON te.id = jll.id)",
    ]
    pred = ("CASE WHEN j0 >= greatest(j1, j2, j3) THEN 'de' WHEN j1 >= greatest(j2, j3) THEN 'en' "
            "WHEN j2 >= j3 THEN 'es' ELSE 'fr' END")
    return O.with_tables(*ctes) + out.format(pred=pred)


@register("m08_complement_nb", _cnb_oracle)
def m08(spark, sf):
    _, pred = _fit_predict(spark, sf, "tfidf_complement_nb")
    return pred.select("id", "label", "prediction")


# ------------------------------------------------------ Spark ML models
@register("m01_logistic_regression")
def m01(spark, sf):
    return _pred_rows(_fit_predict(spark, sf, "tfidf_logistic")[1])


@register("m02_linear_svc_calibrated")
def m02(spark, sf):
    return _pred_rows(_fit_predict(spark, sf, "tfidf_svm")[1])


@register("m04_random_forest")
def m04(spark, sf):
    return _pred_rows(_fit_predict(spark, sf, "tfidf_random_forest")[1])


@register("m05_gradient_boosting")
def m05(spark, sf):
    return _pred_rows(_fit_predict(spark, sf, "tfidf_gradient_boosting")[1])


@register("m06_lightgbm_params")
def m06(spark, sf):
    return _pred_rows(_fit_predict(spark, sf, "lightgbm")[1])


@register("m07_xgboost_params")
def m07(spark, sf):
    return _pred_rows(_fit_predict(spark, sf, "xgboost")[1])


@register("m09_soft_vote")
def m09(spark, sf):
    return _pred_rows(_fit_predict(spark, sf, "ensemble_vote")[1])


@register("m11_batch_scoring")
def m11(spark, sf):
    """Batched inference (32 rows per call) of a multinomial model trained on
    ``embeddings``; the model's weights are shipped to the tasks."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    e = read_table(spark, sf, "embeddings")
    train = e.select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("y"))
    lr = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", maxIter=50).fit(train)
    W = lr.coefficientMatrix.toArray().astype("float32")
    b = lr.interceptVector.toArray().astype("float32")

    def make_fn():
        def predict(x):
            z = x @ W.T + b
            z = z - z.max(axis=1, keepdims=True)
            p = np.exp(z)
            return (p / p.sum(axis=1, keepdims=True)).astype("float32")
        return predict

    scorer = MD.batch_scorer(make_fn, W.shape[1], batch_size=32)
    scored = e.select("vec_id", "label", scorer("embedding").alias("p"))
    labels = [str(i) for i in range(W.shape[0])]
    from ..operators.ranking import argmax_label
    return scored.select("vec_id", "label", argmax_label(F.transform("p", lambda x: x.cast("double")), labels)
                         .cast("int").alias("prediction"))


_M11_K, _M11_DIM = 4, 64


@register("m11_fixed_weights",
          "WITH s AS (SELECT vec_id, label, " + ", ".join(
              "(" + " + ".join(f"{((i * 7 + j * 3) % 11 - 5) / 8!r} * embedding[{j + 1}]" for j in range(_M11_DIM)) + f") AS s{i}"
              for i in range(_M11_K)) + " FROM embeddings) SELECT vec_id, label, CASE WHEN s0 >= greatest(s1, s2, s3) THEN 0 "
          "WHEN s1 >= greatest(s2, s3) THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS prediction FROM s")
def m11_fixed(spark, sf):
    """Batched inference of a linear model whose weights are stated by a rule,
    so SQL can follow it: ``w[i][j] = ((7 i + 3 j) % 11 - 5) / 8``."""
    import numpy as np
    from ..operators.ranking import argmax_label
    W = np.array([[((i * 7 + j * 3) % 11 - 5) / 8 for j in range(_M11_DIM)] for i in range(_M11_K)])

    def make_fn():
        return lambda x: (x.astype("float64") @ W.T).astype("float32")

    scorer = MD.batch_scorer(make_fn, _M11_DIM, batch_size=32)
    scored = read_table(spark, sf, "embeddings").select("vec_id", "label", scorer("embedding").alias("p"))
    return scored.select("vec_id", "label", argmax_label(F.transform("p", lambda x: x.cast("double")),
                                                         [str(i) for i in range(_M11_K)]).cast("int").alias("prediction"))


# ----------------------------------------------------------------- jobs
def _flat_run(rec):
    return rec.select("experiment_name", "data.n_train", "data.n_val", "data.n_test",
                      "cv_results.mean_accuracy", "cv_results.std_accuracy",
                      "test_metrics.accuracy", "test_metrics.macro_f1", "test_metrics.weighted_f1")


def _run_oracle(train: str) -> str:
    """Sizes and rounded test metrics of a Complement NB run without folds."""
    return _cnb_oracle(out="""
, pr AS (SELECT label AS y, {pred} AS p FROM allj)
, c AS (SELECT label, CAST(sum(t) AS DOUBLE) AS nt, CAST(sum(q) AS DOUBLE) AS np, CAST(sum(k) AS DOUBLE) AS tp FROM (
  SELECT y AS label, 1 AS t, 0 AS q, CASE WHEN y = p THEN 1 ELSE 0 END AS k FROM pr UNION ALL SELECT p, 0, 1, 0 FROM pr)
  GROUP BY label)
, f AS (SELECT *, CASE WHEN nt + np = 0 THEN 0 ELSE 2 * tp / (nt + np) END AS f1 FROM c)
, m AS (SELECT round(sum(tp) / sum(nt), 4) AS accuracy, round(avg(f1), 4) AS macro_f1,
  round(sum(f1 * nt) / sum(nt), 4) AS weighted_f1 FROM f)
SELECT 'tfidf_complement_nb' AS experiment_name,
  (SELECT count(*) FROM sp WHERE split = 'train') AS n_train, (SELECT count(*) FROM sp WHERE split = 'val') AS n_val,
  (SELECT count(*) FROM sp WHERE split = 'test') AS n_test,
  CAST(NULL AS DOUBLE) AS mean_accuracy, CAST(NULL AS DOUBLE) AS std_accuracy, accuracy, macro_f1, weighted_f1 FROM m""", train=train)


@register("j01_final_metrics", lambda: _run_oracle("split = 'train'"))
def j01_final(spark, sf):
    """The run of ``j01_train_evaluate`` without its folds, for the SQL oracle."""
    rec, _, _ = J.run_experiment(documents_as_tables(spark, sf), J.preset("tfidf_complement_nb"), cv_folds=0)
    return _flat_run(rec)


@register("j01_train_evaluate")
def j01(spark, sf):
    rec, _, _ = J.run_experiment(documents_as_tables(spark, sf), J.preset("tfidf_complement_nb"))
    return _flat_run(rec)


@register("j02_cross_validation")
def j02(spark, sf):
    cfg = J.preset("tfidf_logistic")
    tv = J.split_docs(documents_as_tables(spark, sf), cfg).where("split <> 'test'").drop("split")
    return J.cross_validate(tv, cfg, k=cfg["training"]["cv_folds"])


@register("j03_final_fit_train_val", lambda: _run_oracle("split <> 'test'"))
def j03(spark, sf):
    cfg = J.preset("tfidf_complement_nb", training={"train_on_train_val": True})
    rec, _, _ = J.run_experiment(documents_as_tables(spark, sf), cfg, cv_folds=0)
    return _flat_run(rec)


def _as_tables(b):
    return b.select(F.col("item_id").alias("id"),
                    F.transform(F.split("text", "\n"), lambda r: F.split(r, ", ")).alias("table_data"))


def _benchmark_tables(spark, sf):
    return _as_tables(read_table(spark, sf, "benchmark"))


_BENCH_SQL = ("SELECT id, CAST(NULL AS VARCHAR) AS label, " + O.render("table_data") + " AS text FROM "
              "(SELECT item_id AS id, list_transform(string_split(text, chr(10)), lambda r: string_split(r, ', ')) "
              "AS table_data FROM benchmark)")


def _j04_oracle() -> str:
    return _cnb_oracle(_BENCH_SQL, "SELECT id, {pred} AS label FROM allj")


@register("j04_score_labels", _j04_oracle)
def j04(spark, sf):
    cfg = J.preset("tfidf_complement_nb")
    train, _ = _split_docs(spark, sf, cfg)
    fitted = J.fit_model(train, cfg)
    return J.score(fitted, _benchmark_tables(spark, sf))


def _j05_oracle() -> str:
    k = range(len(_CNB_CLASSES))
    total = " + ".join(f"exp(j{i} - greatest(j0, j1, j2, j3))" for i in k)
    rows = " UNION ALL ".join(
        f"SELECT id, {{pred}} AS label, {i} AS ci, '{c}' AS class, exp(j{i} - greatest(j0, j1, j2, j3)) / ({total}) AS p FROM allj"
        for i, c in enumerate(_CNB_CLASSES))
    return _cnb_oracle(_BENCH_SQL, ", e AS (" + rows + ") SELECT id, label, CAST(row_number() OVER "
                       "(PARTITION BY id ORDER BY p DESC, ci) AS INTEGER) AS rank, class, round(p, 6) AS p FROM e")


def _ranked_rows(s):
    e = s.select("id", "label", F.posexplode("probabilities").alias("pos", "e"))
    return e.select("id", "label", (F.col("pos") + 1).alias("rank"), F.col("e.label").alias("class"),
                    F.round("e.p", 6).alias("p"))


@register("j05_score_ranked_cnb", _j05_oracle)
def j05_cnb(spark, sf):
    cfg = J.preset("tfidf_complement_nb")
    fitted = J.fit_model(_split_docs(spark, sf, cfg)[0], cfg)
    return _ranked_rows(J.score(fitted, _benchmark_tables(spark, sf), ranked=True))


@register("j05_score_ranked")
def j05(spark, sf):
    cfg = J.preset("tfidf_logistic")
    train, _ = _split_docs(spark, sf, cfg)
    fitted = J.fit_model(train, cfg)
    return _ranked_rows(J.score(fitted, _benchmark_tables(spark, sf), ranked=True))


@register("j07_preset_sweep")
def j07(spark, sf):
    return J.preset_sweep(documents_as_tables(spark, sf),
                          ["tfidf_logistic", "tfidf_complement_nb", "entetes_seuls_logistic", "tfidf_separe_logistic",
                           "features_explicites_logistic", "lemmatisation_logistic", "tfidf_chars", "tfidf_svm", "tfidf_random_forest"])


@register("m03_platt_calibration")
def m03(spark, sf):
    """Calibrated one-vs-rest SVM: per test row the class probabilities (rows
    sum to one), ranked."""
    from ..operators.ranking import ranked_probabilities
    fitted, pred = _fit_predict(spark, sf, "tfidf_svm")
    r = pred.select("id", F.posexplode(ranked_probabilities(F.col("proba"), fitted.classes)).alias("pos", "e"))
    return r.select("id", (F.col("pos") + 1).alias("rank"), F.col("e.label").alias("class"),
                    F.round("e.p", 6).alias("p"))


def _shared_dir(spark, name):
    """A fresh folder under the cluster's shared checkpoint folder."""
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s15_model_save_load", _cnb_oracle)
def s15(spark, sf):
    """Fit, save every artefact, and score the test rows with the scorer that is
    rebuilt from the files alone."""
    from .saved import load_fitted, save_fitted
    cfg = J.preset("tfidf_complement_nb")
    train, test = _split_docs(spark, sf, cfg)
    d = _shared_dir(spark, "s15")
    fitted = J.fit_model(train, cfg)
    save_fitted(fitted, d)
    fitted.release()
    pred = load_fitted(spark, d).predict(test.select("id", "text"))
    return pred.join(test.select("id", "label"), "id").select("id", "label", "prediction")


@register("j08_stream_scoring", _j04_oracle)
def j08(spark, sf):
    """The benchmark table read as a file stream, each micro-batch scored by a
    saved Complement NB run, written per batch id; returns what was written."""
    from ..streaming.scoring import start_scoring_stream
    from .saved import save_fitted
    cfg = J.preset("tfidf_complement_nb")
    train, _ = _split_docs(spark, sf, cfg)
    fitted = J.fit_model(train, cfg)
    out = _shared_dir(spark, "j08")
    save_fitted(fitted, f"{out}-run")
    fitted.release()
    start_scoring_stream(spark, f"{out}-run", None, sf, out, f"{out}-ckpt", schema="item_id long, text string", ranked=False,
                         trigger_once=True, files="benchmark.parquet", prepare=_as_tables).awaitTermination()
    return spark.read.parquet(out).select("id", "label")
