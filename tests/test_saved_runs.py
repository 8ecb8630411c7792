"""Saved runs score from their files alone, for every model and feature kind;
calibration, votes and presets on literal cases."""
import math
import os

import pytest
from pyspark.sql import functions as F

from cartable.operators import metrics as MET
from cartable.operators import models as MD
from cartable.operators import svm as SV
from cartable.plans import jobs as J
from cartable.plans.adapters import documents_as_tables
from cartable.plans.saved import load_fitted, save_fitted
from cartable.sources.runs import STATUS_DONE, STATUS_RUNNING, RunNotFoundError, read_runs

SF = "/root/testdata/sf0.001"
SMALL = {"max_features": 300, "ngram_range": [1, 1], "min_df": 2}
MODELS = {
    "logistic_regression": {"C": 1.0, "max_iter": 5, "class_weight": "balanced"},
    "linear_svc": {"C": 1.0, "max_iter": 5, "class_weight": "balanced"},
    "random_forest": {"n_estimators": 3, "class_weight": "balanced"},
    "gradient_boosting": {"max_iter": 2, "max_depth": 2},
    "lightgbm": {"n_estimators": 2, "num_leaves": 5, "class_weight": "balanced"},
    "xgboost": {"n_estimators": 2, "max_depth": 2},
    "complement_nb": {"alpha": 0.1, "norm": True},
}


@pytest.fixture(scope="module")
def tables(spark):
    return documents_as_tables(spark, SF).where("id < 90").cache()


def rows(df):
    return sorted((r.id, r.label, None if "probabilities" not in df.columns else tuple((p.label, round(p.p, 9)) for p in r.probabilities))
                  for r in df.collect())


def round_trip(spark, tables, cfg, folder, ranked=True):
    fitted = J.fit_model(J.render_docs(tables, cfg["preprocessing"]), cfg)
    save_fitted(fitted, folder)
    want = rows(J.score(fitted, tables, ranked=ranked))
    assert rows(J.score(folder, tables, ranked=ranked)) == want and len(want) == tables.count()
    return fitted


@pytest.mark.parametrize("kind", sorted(MODELS))
def test_round_trip_of_every_model(spark, tables, tmpdir_path, kind):
    cfg = J.preset("tfidf_complement_nb", features={"type": "tfidf", "params": SMALL}, model={"type": kind, "params": MODELS[kind]})
    round_trip(spark, tables, cfg, os.path.join(tmpdir_path, "run"))


@pytest.mark.parametrize("name", ["tfidf_separe_logistic", "lemmatisation_logistic", "features_explicites_logistic", "entetes_seuls_logistic"])
def test_round_trip_of_every_feature_kind(spark, tables, tmpdir_path, name):
    cfg = J.preset(name, model={"type": "complement_nb", "params": MODELS["complement_nb"]})
    round_trip(spark, tables, cfg, os.path.join(tmpdir_path, "run"))


@pytest.mark.parametrize("vote", ["soft", "hard"])
def test_votes(spark, tables, tmpdir_path, monkeypatch, vote):
    monkeypatch.setattr(J, "VOTER_SPECS", {"lr": MD.ModelSpec("logistic_regression", MODELS["logistic_regression"]),
                                           "svm": MD.ModelSpec("linear_svc", MODELS["linear_svc"]),
                                           "rf": MD.ModelSpec("random_forest", MODELS["random_forest"])})
    cfg = J.preset("ensemble_vote", features={"type": "tfidf", "params": SMALL}, model={"type": "ensemble_vote", "params": {"vote": vote}})
    folder = os.path.join(tmpdir_path, "run")
    fitted = round_trip(spark, tables, cfg, folder, ranked=vote == "soft")
    if vote == "hard":
        with pytest.raises(ValueError, match="no probabilities"):
            J.score(folder, tables, ranked=True)
        assert fitted.predict(J.render_docs(tables, {})).where("proba is not null").isEmpty()
    with pytest.raises(ValueError, match="unknown vote"):
        J.fit_model(J.render_docs(tables, {}), {**cfg, "model": {"type": "ensemble_vote", "params": {"vote": "some"}}})


def test_hard_vote_of_one_row(spark):
    p = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    vote = lambda *ps: spark.range(1).select(MD.vote_labels(list(ps), ["a", "b", "c"]).alias("v")).first().v
    assert vote(p(.1, .8, .1), p(.2, .5, .3), p(1, 0, 0)) == "b"
    assert vote(p(0, 0, 1), p(0, 1, 0), p(1, 0, 0)) == "a"  # a tie goes to class order


def test_run_parameters_and_overrides(spark, tables, tmpdir_path):
    cfg = J.preset("tfidf_complement_nb", preprocessing={"max_content_cells": 5})
    folder = os.path.join(tmpdir_path, "run")
    save_fitted(J.fit_model(J.render_docs(tables, cfg["preprocessing"]), cfg), folder)
    own = load_fitted(spark, folder)
    assert own.extra["preprocessing"]["max_content_cells"] == 5
    full = rows(own.predict(J.render_docs(tables, {**cfg["preprocessing"], "max_content_cells": None})).select("id", F.col("prediction").alias("label")))
    assert rows(J.score(folder, tables, max_content_cells=None)) == full


def test_missing_and_unknown(spark, tables, tmpdir_path):
    with pytest.raises(RunNotFoundError):
        load_fitted(spark, os.path.join(tmpdir_path, "nowhere"))
    cfg = J.preset("tfidf_complement_nb")
    fitted = J.fit_model(J.render_docs(tables, {}), cfg)
    fitted.spec = MD.ModelSpec("mystery", {})
    with pytest.raises(ValueError, match="mystery"):
        save_fitted(fitted, os.path.join(tmpdir_path, "run"))


def test_run_is_recorded_from_its_start(spark, tables, tmpdir_path):
    root = os.path.join(tmpdir_path, "models")
    cfg = J.preset("tfidf_complement_nb", data={"labels": ["de", "en", "es", "fr", "xx"]}, training={"save_model": False})
    with pytest.raises(ValueError):
        J.run_experiment(tables, {**cfg, "features": {"type": "nothing"}}, cv_folds=0, out_root=root)
    assert [r.status for r in read_runs(spark, root).collect()] == [STATUS_RUNNING]
    rec, fitted, _ = J.run_experiment(tables, {**cfg, "name": "second"}, cv_folds=0, out_root=root)
    r = rec.first()
    assert r.status == STATUS_DONE and r.test_metrics.par_classe["xx"].support == 0
    with pytest.raises(RunNotFoundError):
        load_fitted(spark, f"{root}/{r.experiment_id}")


def test_platt_targets(spark):
    margins = [(-2.0, 0), (-1.0, 0), (-0.5, 1), (0.3, 0), (0.8, 1), (2.0, 1), (2.5, 1), (3.0, 1)]
    df = spark.createDataFrame(margins, "m double, y int")
    a, b = SV.fit_platt(df, F.col("m"), F.col("y") == 1)
    n1, n0 = 5, 3
    x, y = 0.0, 0.0  # plain Newton on the smoothed targets
    for _ in range(200):
        g, h = [0.0, 0.0], [[1e-12, 0.0], [0.0, 1e-12]]
        for m, t in margins:
            t = (n1 + 1) / (n1 + 2) if t else 1 / (n0 + 2)
            p = 1 / (1 + math.exp(-(x * m + y)))
            for i, u in enumerate((m, 1.0)):
                g[i] += (p - t) * u
                for j, v in enumerate((m, 1.0)):
                    h[i][j] += p * (1 - p) * u * v
        det = h[0][0] * h[1][1] - h[0][1] * h[1][0]
        x, y = x - (h[1][1] * g[0] - h[0][1] * g[1]) / det, y - (h[0][0] * g[1] - h[1][0] * g[0]) / det
    assert abs(a - x) < 1e-4 and abs(b - y) < 1e-4
    sure = spark.createDataFrame([(-1.0, 0), (1.0, 1)] * 4, "m double, y int")
    assert SV.fit_platt(sure, F.col("m"), F.col("y") == 1)[0] < 4  # separable margins do not diverge


def test_estimator_settings():
    lr = MD.build_estimator(MD.ModelSpec("logistic_regression", {"C": 2.0, "max_iter": 1000}), 50)
    assert lr.getMaxIter() == 1000 and abs(lr.getRegParam() - 0.01) < 1e-12
    assert J.PRESETS["tfidf_svm"]["model"]["params"]["max_iter"] == 2000
    assert J.PRESETS["tfidf_random_forest"]["model"]["params"].get("max_depth") is None
    with pytest.raises(ValueError, match="unknown model type"):
        MD.build_estimator(MD.ModelSpec("forest", {}), 50)


def test_confusion_of_quoted_class_names(spark):
    df = spark.createDataFrame([("l'a", "l'a"), ("l'a", "b"), ("b", "b")], "y string, p string")
    got = [tuple(r) for r in MET.confusion_matrix(df, ["b", "l'a"]).orderBy("class_idx").collect()]
    assert got == [("b", 0, 1, 0), ("l'a", 1, 1, 1)]


def test_quarantine_of_malformed_rows(spark, tables, tmpdir_path):
    from cartable.streaming.scoring import start_scoring_stream
    cfg = J.preset("tfidf_complement_nb")
    fitted = J.fit_model(J.render_docs(tables, {}), cfg)
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    spark.createDataFrame([(1, '[["a"]]'), (2, "[[oops"), (3, "null")], "id long, table_data string").write.parquet(src)
    start_scoring_stream(spark, fitted, cfg, src, out, os.path.join(tmpdir_path, "ck"), trigger_once=True).awaitTermination(300)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3]
    assert [(r.id, r.raw) for r in spark.read.parquet(out + "_quarantine").collect()] == [(2, "[[oops")]


def test_positions_when_one_prefix_holds_all(spark):
    from cartable.operators.ranking import global_index
    df = spark.createDataFrame([(f"aa{i:05d}",) for i in range(3000)][::-1], "term string")
    got = [(r.term, r.idx) for r in global_index(df, ["term"]).collect()]
    assert sorted(got) == [(f"aa{i:05d}", i) for i in range(3000)]
