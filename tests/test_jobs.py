"""Jobs end to end on sf0.001: experiment with CV, save / load, batch and
streaming scoring, plan shape of the flagship query."""
import os

import pytest
from pyspark.sql import functions as F

from cartable.plans import jobs as J
from cartable.plans.adapters import documents_as_tables

SF = "/root/testdata/sf0.001"


def test_run_experiment_complement_nb(spark, tmpdir_path):
    tables = documents_as_tables(spark, SF)
    cfg = J.preset("tfidf_complement_nb")
    rec, fitted, pred = J.run_experiment(tables, cfg, cv_folds=3, out_root=os.path.join(tmpdir_path, "models"))
    r = rec.first()
    assert r.data.n_total == tables.count() and r.data.n_test == pred.count()
    assert len(r.cv_results.fold_scores) == 3
    assert set(r.test_metrics.par_classe.keys()) == set(fitted.classes)
    # Probabilities sum to one; beat the majority class on the language label.
    tot = pred.select(F.aggregate("proba", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(x.s - 1) < 1e-9 for x in tot)
    majority = tables.groupBy("label").count().agg(F.max("count")).first()[0] / tables.count()
    assert r.test_metrics.accuracy > majority
    from cartable.sources.runs import read_runs
    runs = read_runs(spark, os.path.join(tmpdir_path, "models")).collect()
    assert runs[0].experiment_name == "tfidf_complement_nb"
    from cartable.plans.saved import load_run
    from cartable.sources.runs import RunNotFoundError
    rec2, cfg2, loaded = load_run(spark, runs[0]._path)
    assert rec2.status == "terminee" and cfg2["classes"] == fitted.classes == loaded.classes
    assert loaded.featurizer.models[0].vocab.count() == fitted.featurizer.size
    assert loaded.model.count() == fitted.model.count()
    import pytest
    with pytest.raises(RunNotFoundError):
        load_run(spark, os.path.join(tmpdir_path, "nowhere"))


def test_logistic_regression_and_scoring(spark):
    cfg = J.preset("tfidf_logistic")
    tables = documents_as_tables(spark, SF)
    fitted = J.fit_model(J.render_docs(tables, cfg["preprocessing"]), cfg)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select(
        F.col("item_id").alias("id"), F.transform(F.split("text", "\n"), lambda r: F.split(r, ", ")).alias("table_data"))
    out = J.score(fitted, bench, cfg, ranked=True).collect()
    assert len(out) == bench.count()
    for r in out:
        ps = [x.p for x in r.probabilities]
        assert ps == sorted(ps, reverse=True) and r.label == r.probabilities[0].label


def test_streaming_scoring(spark, tmpdir_path):
    from cartable.streaming.scoring import start_scoring_stream
    cfg = J.preset("tfidf_complement_nb")
    tables = documents_as_tables(spark, SF)
    fitted = J.fit_model(J.render_docs(tables, cfg["preprocessing"]), cfg)
    src = os.path.join(tmpdir_path, "incoming")
    tables.select("id", F.to_json("table_data").alias("table_data")).write.parquet(src)
    out = os.path.join(tmpdir_path, "scored")
    q = start_scoring_stream(spark, fitted, cfg, src, out, os.path.join(tmpdir_path, "ckpt"), trigger_once=True)
    q.awaitTermination(300)
    assert spark.read.parquet(out).count() == tables.count()


def test_flagship_plan_shape(spark):
    from cartable.plans.flagship import query
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    df = query(spark, SF)
    assert df.columns == ["label", "rank", "term", "mean_tfidf"] and df.count() > 0


def test_cv_counts_once_equals_refit_per_fold(spark):
    from cartable.operators import metrics as MET
    from cartable.operators import split as SP
    cfg = J.preset("tfidf_complement_nb")
    docs = J.render_docs(documents_as_tables(spark, SF), cfg["preprocessing"])
    fast = {r.fold: r.score for r in J.cross_validate(docs, cfg, k=3).collect()}
    folded = SP.assign_folds(docs, k=3)
    for f in range(3):
        fit = J.fit_model(SP.fold_train(folded, f).drop("fold"), cfg)
        held = SP.fold_valid(folded, f).drop("fold")
        pred = fit.predict(held).join(held.select("id", "label"), "id")
        acc = MET.accuracy(pred, y="label", p="prediction").first()["accuracy"]
        assert abs(acc - fast[f]) < 1e-12


def test_cv_scorer_by_name(spark):
    import pytest
    cfg = J.preset("tfidf_complement_nb", training={"scoring": "f1_macro"})
    docs = J.render_docs(documents_as_tables(spark, SF), cfg["preprocessing"])
    scores = J.cross_validate(docs, cfg, k=2).collect()
    assert len(scores) == 2 and all(0 <= r.score <= 1 for r in scores)
    with pytest.raises(ValueError, match="unknown scorer"):
        J.cross_validate(docs, J.preset("tfidf_complement_nb", training={"scoring": "nope"}), k=2)


def test_flagship_shuffles_text_once(spark):
    """The text is hash-partitioned by id once, and no other exchange on id
    separates the per-document count from the norm window. (That the
    vocabulary branch reuses this exchange was checked by hand on the sf0.1
    plan; the final-plan string does not always print finished broadcast
    stages, so it is not asserted here.)"""
    from cartable.plans.flagship import query
    # At sf0.01 the final plan string prints the finished broadcast stage too.
    df = query(spark, "/root/testdata/sf0.01")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    text_exchanges = [ln for ln in final.split("\n") if "Exchange hashpartitioning(id" in ln and "ReusedExchange" not in ln]
    assert len(text_exchanges) == 1


def test_tasks_side_by_side_overlap_and_stop_on_error(spark):
    import time

    from cartable.session import side_by_side
    group = lambda: spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    spans = []

    def task(i):
        t = time.time()
        n = spark.range(10).repartition(2).count()
        time.sleep(0.3)
        spans.append((t, time.time(), group()))
        return n + i
    assert side_by_side(spark, [lambda i=i: task(i) for i in range(4)], "t", 4) == [10, 11, 12, 13]
    assert max(a for a, _, _ in spans) < min(b for _, b, _ in spans) and sorted(g for *_, g in spans) == [f"t-{i}" for i in range(4)]
    assert group() is None
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1 / 0, lambda: 1], "t", 2)
    assert side_by_side(spark, [lambda: 5], "t") == [5]


def test_folds_one_by_one_and_side_by_side_agree(spark):
    tables = documents_as_tables(spark, SF).where("id < 120")
    cfg = J.preset("tfidf_complement_nb", features={"type": "tfidf", "params": {"max_features": 300}})
    docs = J.render_docs(tables, cfg["preprocessing"])
    score = lambda n: sorted(map(tuple, J.cross_validate(docs, {**cfg, "training": {"parallel_folds": n}}, k=3).collect()))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    assert score(1) == score(3)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
