"""User-level jobs (J01-J07) and the named presets.

``run_experiment`` = split -> render -> cross-validation with fold-local
vocabularies -> final fit -> test metrics -> run record. Features are
fitted on training rows only; every other set is transformed with the frozen
vocabulary.
"""
from __future__ import annotations

import copy
import datetime
import functools
import json
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import preprocess_params, render_text, split_separated
from ..operators import boosting as BO
from ..operators import forest as FO
from ..operators import metrics as MET
from ..operators import models as MD
from ..operators import split as SP
from ..operators import svm as SV
from ..operators import tfidf as TF
from ..operators.features import keyword_long, lemmatize, plural_lemma_dictionary
from ..operators.ranking import ranked_probabilities
from ..session import side_by_side

# Folds of a cross-validation, and presets of a sweep, that run side by side.
PARALLEL_FOLDS = 4
# The experiment presets (feature + model parameters).
_SVC = {"type": "linear_svc", "params": {"C": 1.0, "max_iter": 2000, "class_weight": "balanced"}}
_LR = {"type": "logistic_regression", "params": {"C": 1.0, "max_iter": 1000, "class_weight": "balanced"}}
_TF = {"max_features": 15000, "ngram_range": [1, 2], "sublinear_tf": True, "min_df": 2}
_TF10 = {"max_features": 10000, "ngram_range": [1, 2], "sublinear_tf": True, "min_df": 2}
PRESETS: dict[str, dict] = {
    "tfidf_logistic": {"features": {"type": "tfidf", "params": {**_TF, "analyzer": "word"}}, "model": _LR},
    "tfidf_svm": {"features": {"type": "tfidf", "params": _TF},
                  "model": _SVC},
    "tfidf_random_forest": {"features": {"type": "tfidf", "params": _TF10},
                            "model": {"type": "random_forest", "params": {
                                "n_estimators": 300, "class_weight": "balanced",
                                "random_state": 42}}},
    "tfidf_gradient_boosting": {"features": {"type": "tfidf", "params": _TF10},
                                "model": {"type": "gradient_boosting", "params": {
                                    "max_iter": 300, "learning_rate": 0.1, "max_depth": 6, "random_state": 42}}},
    "tfidf_complement_nb": {"features": {"type": "tfidf", "params": _TF},
                            "model": {"type": "complement_nb", "params": {"alpha": 0.1, "norm": True}}},
    "tfidf_chars": {"features": {"type": "tfidf", "params": {
        "max_features": 20000, "ngram_range": [2, 4], "sublinear_tf": True, "min_df": 2, "analyzer": "char_wb"}},
        "model": _LR},
    "tfidf_separe_logistic": {"preprocessing": {"header_rows": 1, "layout": "separe"},
                              "features": {"type": "tfidf_separe",
                                           "params_entetes": {**_TF10, "min_df": 1},
                                           "params_contenu": {**_TF10, "max_features": 5000, "min_df": 2}},
                              "model": _LR},
    "entetes_seuls_logistic": {"preprocessing": {"header_rows": 1, "layout": "entetes_seuls"},
                               "features": {"type": "tfidf", "params": {**_TF10, "min_df": 1}}, "model": _LR},
    "features_explicites_logistic": {"features": {"type": "features_explicites", "params": _TF10}, "model": _LR},
    "lemmatisation_logistic": {"features": {"type": "tfidf_lemmatise", "params": _TF}, "model": _LR},
    "lightgbm": {"features": {"type": "tfidf", "params": _TF10},
                 "model": {"type": "lightgbm", "params": {"n_estimators": 300, "learning_rate": 0.1, "num_leaves": 63,
                                                         "class_weight": "balanced", "random_state": 42}}},
    "xgboost": {"features": {"type": "tfidf", "params": _TF10},
                "model": {"type": "xgboost", "params": {"n_estimators": 300, "learning_rate": 0.1, "max_depth": 6,
                                                        "random_state": 42}}},
    "ensemble_vote": {"features": {"type": "tfidf", "params": _TF},
                      "model": {"type": "ensemble_vote", "params": {"vote": "soft"}}, "training": {"cv_folds": 3}},
}
BASE = {"data": {"test_size": 0.2, "val_size": 0.1, "stratify": True, "random_seed": 42, "labels": None},
        "preprocessing": {"header_rows": 1, "header_weight": 3, "max_content_cells": 200},
        "training": {"cv_folds": 5, "scoring": "accuracy", "train_on_train_val": False}}


def preset(name: str, **overrides) -> dict:
    """Merged configuration of a named preset."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; available: {sorted(PRESETS)}")
    cfg = copy.deepcopy(BASE)
    for k, v in PRESETS[name].items():
        cfg[k] = {**cfg.get(k, {}), **copy.deepcopy(v)} if isinstance(v, dict) else v
    cfg["name"] = name
    for k, v in overrides.items():
        cfg[k] = {**cfg.get(k, {}), **v} if isinstance(v, dict) and isinstance(cfg.get(k), dict) else v
    return cfg


# --------------------------------------------------------------- features
@dataclass
class Featurizer:
    """Fitted feature extractor: frozen vocabularies + how to apply them."""
    kind: str
    models: list
    size: int
    lemma_dict: DataFrame | None = None
    lexicon: dict | None = None

    def long(self, docs: DataFrame) -> DataFrame:
        """``(id, idx, weight)`` for ``docs(id, text[, header, body])``."""
        if self.kind == "tfidf_separe":
            h, b = self.models
            hl = h.features(docs.select("id", F.col("header").alias("text")))
            return hl.unionByName(b.features(docs.select("id", F.col("body").alias("text")), offset=h.size))
        src = lemmatize(docs, self.lemma_dict) if self.kind == "tfidf_lemmatise" else docs
        m = self.models[0]
        out = m.features(src.select("id", "text"))
        if self.kind == "features_explicites":
            out = out.unionByName(keyword_long(docs, F.lit(m.size), self.lexicon))
        return out

    def vectors(self, docs: DataFrame, carry=("label",)) -> DataFrame:
        keep = [c for c in carry if c in docs.columns]
        vec = TF.sparse_rows(self.long(docs), docs.select("id"), self.size)
        return docs.select("id", *keep).join(vec, "id")

    def release(self) -> None:
        """Drop the cached vocabularies and dictionary."""
        for m in self.models:
            m.vocab.unpersist()
        if self.lemma_dict is not None:
            self.lemma_dict.unpersist()


def fit_features(train_docs: DataFrame, fcfg: dict) -> Featurizer:
    kind = fcfg.get("type", "tfidf")
    if kind == "tfidf_separe":
        hp = TF.TfidfParams.from_dict(fcfg.get("params_entetes", {"max_features": 10000}))
        bp = TF.TfidfParams.from_dict(fcfg.get("params_contenu", {"max_features": 5000}))
        h = TF.fit_tfidf(train_docs.select("id", F.col("header").alias("text")), hp)
        b = TF.fit_tfidf(train_docs.select("id", F.col("body").alias("text")), bp)
        return Featurizer(kind, [h, b], h.size + b.size)
    p = TF.TfidfParams.from_dict(fcfg.get("params", {}))
    if kind == "tfidf_lemmatise":
        d = plural_lemma_dictionary(train_docs).cache()
        m = TF.fit_tfidf(lemmatize(train_docs, d), p)
        return Featurizer(kind, [m], m.size, lemma_dict=d)
    if kind not in ("tfidf", "features_explicites"):
        raise ValueError(f"unknown feature type {kind!r}")
    m = TF.fit_tfidf(train_docs.select("id", "text"), p)
    extra = 3 if kind == "features_explicites" else 0
    return Featurizer(kind, [m], m.size + extra)


def render_docs(tables: DataFrame, pre: dict) -> DataFrame:
    """Text (and header / body for the separate layout)."""
    params = preprocess_params(**pre)
    carry = [c for c in ("label", "split", "fold") if c in tables.columns]
    out = tables.select("id", *carry, render_text("table_data", **params).alias("text"))
    if params["layout"] == "separe":
        h, b = split_separated(F.col("text"))
        out = out.select("*", h.alias("header"), b.alias("body"))
    return out


# ----------------------------------------------------------------- models
@dataclass
class Fitted:
    spec: MD.ModelSpec
    classes: list
    model: object
    featurizer: Featurizer
    extra: dict = field(default_factory=dict)

    def predict(self, docs: DataFrame) -> DataFrame:
        """``(id, prediction, proba)``; proba in class order."""
        return self.predict_long(self.featurizer.long(docs), docs.select("id"))

    @property
    def gives_probabilities(self) -> bool:
        return not (self.spec.type == "ensemble_vote" and self.spec.params.get("vote", "soft") == "hard")

    def predict_long(self, long: DataFrame, ids: DataFrame) -> DataFrame:
        """Predict from long-form features ``(id, idx, weight)``; ``ids`` keeps
        documents without any feature. A hard vote has no probabilities: its
        ``proba`` is null."""
        from ..operators.ranking import argmax_label
        t = self.spec.type
        if t == "complement_nb":
            bounded = self.featurizer.size <= TF.BROADCAST_VOCAB_MAX
            return MD.predict_complement_nb(long, self.model, self.classes, ids, bounded=bounded).select(
                "id", "prediction", "proba")
        if t in (*MD.BOOSTED, "random_forest", "linear_svc"):
            rows = TF.feature_lists(long, ids)
            pr = self.model.predict(rows) if t == "random_forest" else rows.select(
                "id", self.model.probabilities(F.col("f"), F.col("v")).alias("proba"))
            return pr.select("id", argmax_label(F.col("proba"), self.classes).alias("prediction"), "proba")
        vec = TF.sparse_rows(long, ids, self.featurizer.size)
        if t == "ensemble_vote":
            lr, svm, rf = self.model
            lists = TF.feature_lists(long, ids)
            pr = MD.predict_proba(lr, vec, MD.ModelSpec("logistic_regression", {}), "_a").select("id", "_a")
            pr = pr.join(lists.select("id", svm.probabilities(F.col("f"), F.col("v")).alias("_b")), "id")
            pr = pr.join(rf.predict(lists).withColumnRenamed("proba", "_c"), "id")
            votes = [F.col(c) for c in ("_a", "_b", "_c")]
            if not self.gives_probabilities:
                return pr.select("id", MD.vote_labels(votes, self.classes).alias("prediction"),
                                 F.lit(None).cast("array<double>").alias("proba"))
            pr = pr.withColumn("proba", MD.mean_arrays(votes))
        else:
            pr = MD.predict_proba(self.model, vec, self.spec)
        return pr.select("id", argmax_label(F.col("proba"), self.classes).alias("prediction"), "proba")

    def release(self) -> None:
        """Drop what the fit keeps cached."""
        if isinstance(self.model, DataFrame):
            self.model.unpersist()
        for m in self.model if isinstance(self.model, tuple) else (self.model,):
            if isinstance(m, FO.RandomForest):
                m.release()
        self.featurizer.release()


def fit_model(train_docs: DataFrame, cfg: dict, seed: int = 42) -> Fitted:
    """Fit features on ``train_docs`` then the classifier."""
    feat = fit_features(train_docs, cfg["features"])
    fitted = fit_model_long(feat.long(train_docs), train_docs.select("id", "label"), cfg, feat, seed)
    fitted.extra["preprocessing"] = dict(cfg.get("preprocessing", {}))
    return fitted


VOTER_SPECS = {
    "lr": MD.ModelSpec("logistic_regression", {"C": 1.0, "max_iter": 1000, "class_weight": "balanced"}),
    "svm": MD.ModelSpec("linear_svc", dict(_SVC["params"])),
    "rf": MD.ModelSpec("random_forest", {"n_estimators": 200, "class_weight": "balanced"}),
}


def fit_model_long(long: DataFrame, labels: DataFrame, cfg: dict, feat: Featurizer, seed: int = 42) -> Fitted:
    """Fit the classifier on long-form features of the training rows.

    Weights and calibration folds come from ``(id, label)`` alone; the vectors
    are built once, cached for the fit and released after it."""
    spec = MD.ModelSpec(cfg["model"]["type"], cfg["model"].get("params", {}))
    if spec.type == "ensemble_vote" and spec.params.get("vote", "soft") not in ("soft", "hard"):
        raise ValueError(f"unknown vote {spec.params['vote']!r}; expected 'soft' or 'hard'")
    classes = sorted(r.label for r in labels.select("label").distinct().collect())  # bounded: classes
    if spec.type == "complement_nb":
        model = MD.fit_complement_nb(long.join(labels, "id"), classes, float(spec.params.get("alpha", 1.0)),
                                     bool(spec.params.get("norm", False)))
        return Fitted(spec, classes, model, feat)
    idx = {c: i for i, c in enumerate(classes)}
    lab = F.element_at(F.create_map(*[x for c, i in idx.items() for x in (F.lit(c), F.lit(float(i)))]), F.col("label"))
    rows = MET.with_class_weights(labels.select("id", "label")).withColumn("label_idx", lab)
    if spec.type in MD.BOOSTED:
        if spec.params.get("class_weight") != "balanced":
            rows = rows.withColumn("weight", F.lit(1.0))
        return Fitted(spec, classes, BO.fit_boosted(long, rows, len(classes), BO.boosting_params(spec.type, spec.params)), feat)
    forest = lambda weighted, params: FO.fit_forest(
        long, weighted, len(classes), feat.size, FO.forest_params({"random_state": seed, **params}))
    if spec.type == "random_forest":
        if spec.params.get("class_weight") != "balanced":
            rows = rows.withColumn("weight", F.lit(1.0))
        return Fitted(spec, classes, forest(rows, spec.params), feat)
    k, svm = len(classes), None
    if spec.type in ("linear_svc", "ensemble_vote"):
        folds = SP.assign_folds(labels.select("id", "label"), k=3, seed=seed, out="_cal_fold").drop("label")
        params = spec.params if spec.type == "linear_svc" else VOTER_SPECS["svm"].params
        svm = SV.fit_calibrated_svm(TF.feature_lists(long, labels), rows.join(folds, "id"), k, feat.size, params)
        if spec.type == "linear_svc":
            return Fitted(spec, classes, svm, feat)
    cached = rows.join(TF.sparse_rows(long, labels.select("id"), feat.size), "id").cache()
    n = cached.count()  # balanced weights sum to the number of rows
    vec = MD.sized_partitions(cached)
    if spec.type == "ensemble_vote":
        model = (MD.build_estimator(VOTER_SPECS["lr"], n).fit(vec), svm, forest(rows, VOTER_SPECS["rf"].params))
    else:
        model = MD.build_estimator(spec, n).fit(vec)
    cached.unpersist()
    return Fitted(spec, classes, model, feat)


# ------------------------------------------------------------------- jobs
# CV scorer names and the metric column each one reads.
SCORERS = {"accuracy": "accuracy", "f1_macro": "macro_f1", "f1_weighted": "weighted_f1"}


def _score(pred: DataFrame, scoring: str) -> float:
    if scoring not in SCORERS:
        raise ValueError(f"unknown scorer {scoring!r}; available: {sorted(SCORERS)}")
    row = MET.summary_metrics(pred, y="label", p="prediction").first()
    return float(row[SCORERS[scoring]] or 0.0)


def cross_validate(tv_docs: DataFrame, cfg: dict, k: int, seed: int = 42) -> DataFrame:
    """K folds over train+val; the vocabulary is refitted on the
    training folds of each fold (no leakage). Returns ``(fold, score)``.

    For plain TF-IDF features the terms are counted once for all folds: a term's
    statistics outside a fold are its totals less those of the fold, and the terms
    of any fold's vocabulary are kept as one row of numbers per document. Other
    feature types refit the whole extractor per fold.
    """
    scoring = cfg.get("training", {}).get("scoring", "accuracy")
    if scoring not in SCORERS:
        raise ValueError(f"unknown scorer {scoring!r}; available: {sorted(SCORERS)}")
    # Ranks move (id, label) only; the text is joined to its fold once.
    folds = SP.assign_folds(tv_docs.select("id", "label"), k=k, seed=seed).drop("label")
    folded = tv_docs.join(folds, "id")
    spark = tv_docs.sparkSession
    fcfg, counts = cfg["features"], None
    p = TF.TfidfParams.from_dict(fcfg.get("params", {}))
    once = (fcfg.get("type", "tfidf") == "tfidf" and TF.counted_in_tasks(p) and p.max_features is not None
            and p.max_features <= TF.SHIPPED_VOCAB_MAX)
    kept = (folded.select("id", "label", "fold") if once else folded).cache()  # texts only where every fold reads them

    def scored(fit: Fitted, pred: DataFrame) -> float:
        try:
            return _score(pred, scoring)
        finally:
            fit.release()

    def refit(f: int) -> tuple:
        fit = fit_model(SP.fold_train(kept, f).drop("fold"), cfg, seed)
        held = SP.fold_valid(kept, f).drop("fold")
        return f, scored(fit, fit.predict(held).join(held.select("id", "label"), "id"))

    def vocabulary(f: int) -> list:
        n = total - sizes.get(f, 0)
        outside = stats.select("term", F.col(f"df_{f}").alias("df"), F.col(f"cf_{f}").alias("cf")).where("df > 0")
        return TF.fit_vocabulary(None, n, p, stats=TF.frequent_terms(outside, p, F.lit(n)), exact_cut=False).select(
            "term", "idx", "idf").collect()  # bounded: max_features

    def from_counts(f: int) -> tuple:
        size = len(vocabs[f])
        idx, idf = np.full(len(place), -1, np.int32), np.zeros(len(place))
        for r in vocabs[f]:
            idx[place[r["term"]]], idf[place[r["term"]]] = r["idx"], r["idf"]
        feat = Featurizer("tfidf", [], size)
        long = lambda c: TF.weighted_long(TF.cells_of_vocabulary(merged(c), idx, idf, ["id"]), p)
        fit = fit_model_long(long(counts.where(F.col("fold") != f)), labels.where(F.col("fold") != f).drop("fold"), cfg, feat, seed)
        held = labels.where(F.col("fold") == f)
        pred = fit.predict_long(long(counts.where(F.col("fold") == f)), held.select("id"))
        return f, scored(fit, pred.join(held.select("id", "label"), "id"))

    try:
        if once:
            labels = kept
            sizes = {r["fold"]: r["n"] for r in labels.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
            total = sum(sizes.values())
            staged = TF.staged_texts(folded, p, carry=["fold"])
            stats = TF.statistics_outside(staged, p, "fold", k).persist()
            vocabs = [vocabulary(f) for f in range(k)]
            stats.unpersist()
            place = {t: i for i, t in enumerate(sorted({r["term"] for v in vocabs for r in v}))}
            counts = TF.known_counts(staged, p, list(place), ["id", "fold"]).persist()
            # An id that repeats may lie in several folds; outside another one it is one document.
            if counts.groupBy("id").count().where("count > 1").limit(1).count():
                merged = lambda c: c.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))
            else:
                merged = lambda c: c
        fold = refit if counts is None else from_counts
        rows = side_by_side(spark, [functools.partial(fold, f) for f in range(k)], "fold",
                            int(cfg.get("training", {}).get("parallel_folds", PARALLEL_FOLDS)))
    finally:
        if counts is not None:
            counts.unpersist()
        kept.unpersist()
    return spark.createDataFrame(rows, "fold int, score double")


def split_docs(tables: DataFrame, cfg: dict) -> DataFrame:
    """Rendered documents with their ``split``: the split ranks ``(id, label)``
    only, and the text meets it in one join."""
    d = cfg["data"]
    split = SP.assign_split(tables.select("id", "label"), test_size=d["test_size"], val_size=d["val_size"],
                            stratify=d.get("stratify", True), seed=int(d.get("random_seed", 42)))
    return render_docs(tables, cfg.get("preprocessing", {})).join(split.select("id", "split"), "id")


def run_experiment(tables: DataFrame, cfg: dict, cv_folds: int | None = None, out_root: str | None = None,
                   docs: DataFrame | None = None, runs_table: str | None = None):
    """J01 (+J02, J03): returns ``(run record DataFrame, Fitted, test predictions)``.

    ``docs`` takes documents split and rendered before (``split_docs``). With
    ``out_root`` the run is recorded as running when it starts and as finished
    at the end, and every artefact is saved unless ``training.save_model`` is
    off. Per-class metrics use ``data.labels``, the configured classes, where
    they are given."""
    from ..sources.runs import STATUS_DONE, STATUS_RUNNING, claim_run, run_id, write_run
    from .saved import save_fitted
    t0 = time.time()
    spark = tables.sparkSession
    seed = int(cfg["data"].get("random_seed", 42))
    name = cfg.get("name", "experiment")
    started = {"experiment_id": claim_run(spark, out_root, name) if out_root else run_id(name), "experiment_name": cfg.get("name", "experiment"),
               "timestamp": datetime.datetime.now().isoformat(), "status": STATUS_RUNNING, "config": cfg}
    if out_root:
        write_run(spark, started, out_root)
    own = docs is None
    docs = split_docs(tables, cfg).cache() if own else docs
    train = docs.where("split = 'train'").drop("split")
    val = docs.where("split = 'val'").drop("split")
    test = docs.where("split = 'test'").drop("split")
    k = cfg.get("training", {}).get("cv_folds", 5) if cv_folds is None else cv_folds
    cv = None
    if k and k > 1:
        scores = cross_validate(SP.union_train_val(train, val), cfg, k, seed)
        cv = MET.cv_summary(scores).first()
    final_train = SP.union_train_val(train, val) if cfg.get("training", {}).get("train_on_train_val") else train
    t1 = time.time()
    fitted = fit_model(final_train, cfg, seed)
    duration = time.time() - t1
    labels = cfg["data"].get("labels") or fitted.classes
    pred = fitted.predict(test).join(test.select("id", "label"), "id").cache()
    met = MET.all_metrics(pred, labels, y="label", p="prediction").first()
    sizes = {r["split"]: r["n"] for r in docs.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    from ..sources.tables import class_distribution
    dist = {r["label"]: r["n"] for r in class_distribution(docs).collect()}  # one row per class
    if own:
        docs.unpersist()
    rec = {
        **started,
        "duration_seconds": round(duration, 2),
        "status": STATUS_DONE,
        "data": {"n_train": sizes.get("train", 0), "n_val": sizes.get("val", 0), "n_test": sizes.get("test", 0),
                 "n_total": sum(sizes.values()), "distribution_classes": dist},
        # Field names follow the run-record layout; the scorer that produced
        # them is stored in the configuration (``training.scoring``).
        "cv_results": None if cv is None else {
            "mean_accuracy": round(float(cv["mean_score"]), 4), "std_accuracy": round(float(cv["std_score"]), 4),
            "fold_scores": [round(float(x), 4) for x in cv["fold_scores"]]},
        "test_metrics": {"accuracy": met["accuracy"], "macro_f1": met["macro_f1"], "weighted_f1": met["weighted_f1"],
                         "par_classe": {k2: v.asDict() for k2, v in met["par_classe"].items()}},
        "config": {**cfg, "classes": fitted.classes, "total_seconds": round(time.time() - t0, 2)},
    }
    if out_root:
        rec_df = write_run(spark, rec, out_root, table=runs_table)
        if cfg.get("training", {}).get("save_model", True):
            save_fitted(fitted, f"{out_root.rstrip('/')}/{rec['experiment_id']}")
    else:
        from ..sources.runs import run_frame
        rec_df = run_frame(spark, rec)
    return rec_df, fitted, pred


def score(run: Fitted | str, tables: DataFrame, cfg: dict | None = None, ranked: bool = False, **overrides) -> DataFrame:
    """Label (and ranked probabilities) for new tables.

    ``run`` is a fit or the folder of a saved run. Tables are rendered with the
    run's own parameters (P12); ``cfg["preprocessing"]`` and ``overrides`` replace
    them key by key."""
    if isinstance(run, str):
        from .saved import load_fitted
        run = load_fitted(tables.sparkSession, run)
    if ranked and not run.gives_probabilities:
        raise ValueError("a hard vote gives labels, no probabilities: score it with ranked=False")
    pre = {**run.extra.get("preprocessing", {}), **(cfg or {}).get("preprocessing", {}), **overrides}
    pred = run.predict(render_docs(tables, pre))
    if not ranked:
        return pred.select("id", F.col("prediction").alias("label"))
    return pred.select("id", F.col("prediction").alias("label"),
                       ranked_probabilities(F.col("proba"), run.classes).alias("probabilities"))


def preset_sweep(tables: DataFrame, names: list[str], cv_folds: int = 0, runs_table: str | None = None,
                 out_root: str | None = None, at_once: int = PARALLEL_FOLDS) -> DataFrame:
    """Several presets on the same split; one metrics row per preset.
    Presets that render alike share one rendered, split frame, and run side by side."""
    shared: dict = {}
    cfgs = [preset(name) for name in names]
    key = lambda cfg: json.dumps([cfg["data"], cfg.get("preprocessing", {})], sort_keys=True)
    for cfg in cfgs:
        if key(cfg) not in shared:
            shared[key(cfg)] = split_docs(tables, cfg).cache()

    def run(cfg: dict) -> tuple:
        rec, fitted, pred = run_experiment(tables, cfg, cv_folds=cv_folds, docs=shared[key(cfg)], out_root=out_root, runs_table=runs_table)
        r = rec.first()
        pred.unpersist()
        fitted.release()
        m = r["test_metrics"]
        return r["experiment_name"], m["accuracy"], m["macro_f1"], m["weighted_f1"]

    try:
        rows = side_by_side(tables.sparkSession, [functools.partial(run, c) for c in cfgs], "preset", at_once)
    finally:
        for docs in shared.values():
            docs.unpersist()
    out = tables.sparkSession.createDataFrame(rows, "experiment_name string, accuracy double, macro_f1 double, weighted_f1 double")
    return out.orderBy(F.desc("accuracy"), "experiment_name")
