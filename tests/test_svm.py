"""Squared-hinge SVM and grouped sigmoids against plain solvers."""
import math

import numpy as np
import pyarrow as pa
import pytest

from cartable.operators import svm as S
from tests.test_boosting import data, frames


def dense_rows(rows, features):
    x = np.zeros((len(rows), features + 1))
    x[:, -1] = 1.0
    for i, r in enumerate(rows):
        for f, v in r.items():
            x[i, f] = v
    return x


def plain_svm(x, sign, weight):
    """Newton's method on |w|^2 / 2 + sum weight * max(0, 1 - margin)^2."""
    w = np.zeros(x.shape[1])
    loss = lambda w: 0.5 * w @ w + (weight * np.maximum(1 - sign * (x @ w), 0) ** 2).sum()
    for _ in range(200):
        short = np.maximum(1 - sign * (x @ w), 0)
        g = w - 2 * x.T @ (weight * sign * short)
        on = weight * (short > 0)
        step = np.linalg.solve(np.eye(len(w)) + 2 * (x * on[:, None]).T @ x, g)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-12:
            t /= 2
        w = w - t * step
        if np.abs(g).max() < 1e-12:
            break
    return w, loss(w)


def kept(spark, rows, y, folds):
    return spark.createDataFrame([(k, f, list(map(int, sorted(r))), [float(r[i]) for i in sorted(r)]) for r, k, f in zip(rows, y, folds)],
                                 "y int, fold int, f array<int>, v array<double>").repartition(5).cache()


@pytest.mark.parametrize("direct", [0, 8])
def test_all_problems_reach_the_plain_optimum(spark, monkeypatch, direct):
    monkeypatch.setattr(S, "DIRECT_PARTITIONS", direct)
    monkeypatch.setattr(S, "BLOCK", 3)
    rows, y = data(31, n=70, features=7)
    folds = [i % 3 for i in range(70)]
    problems = [S.Problem(k, f, (1.0, 2.0, 0.5)) for f in (0, 1, None) for k in range(3)]
    w = S.solve(kept(spark, rows, y, folds), problems, 7, 0.7, 2000, tol=1e-9)
    x = dense_rows(rows, 7)
    for p, got in zip(problems, w):
        weight = np.array([0.7 * p.class_weights[k] * (f != p.fold) for k, f in zip(y, folds)])
        sign = np.where(np.array(y) == p.label, 1.0, -1.0)
        want, best = plain_svm(x, sign, weight)
        assert np.abs(got - want).max() < 1e-6
        loss = 0.5 * got @ got + (weight * np.maximum(1 - sign * (x @ got), 0) ** 2).sum()
        assert abs(loss - best) < 1e-6


def test_a_problem_passes_over_the_fold_it_leaves_out():
    """Values of that fold would spoil every sum they enter; the others' sums stay."""
    import pyarrow as pa
    rows, y = data(35, n=50, features=7)
    folds = [i % 3 for i in range(50)]
    values = [[float(r[i]) if k else math.nan for i in sorted(r)] for r, k in zip(rows, folds)]
    batch = pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(folds, pa.int32()), pa.array([sorted(r) for r in rows], pa.list_(pa.int32())),
                                        pa.array(values, pa.list_(pa.float64()))], ["y", "fold", "f", "v"])
    packed = list(S._pack(iter([batch.slice(0, 20), batch.slice(20), batch.slice(0, 0)])))
    assert [p.num_rows for p in packed] == [1, 1]
    w = np.random.default_rng(1).normal(size=(1, 8))
    out = next(S._losses(w, [S.Problem(1, 0, (1.0, 2.0, 0.5))], 0.7)(iter(packed)))
    loss, grad = (np.frombuffer(x) for x in out.column("part").to_pylist())
    x = dense_rows(rows, 7)
    sign = np.where(np.array(y) == 1, 1.0, -1.0)
    weight = np.array([0.7 * (1.0, 2.0, 0.5)[k] * (f != 0) for k, f in zip(y, folds)])
    short = np.maximum(1 - sign * (x @ w[0]), 0)
    assert abs(loss[0] - (weight * short ** 2).sum()) < 1e-9 and np.abs(grad + 2 * x.T @ (weight * sign * short)).max() < 1e-9


def test_iterations_mean_iterations(spark):
    rows, y = data(32, n=40)
    frame = kept(spark, rows, y, [0] * 40)
    none = S.solve(frame, [S.Problem(0, None, (1.0,) * 3)], 7, 1.0, 0)
    one = S.solve(frame, [S.Problem(0, None, (1.0,) * 3)], 7, 1.0, 1, tol=0.0)
    assert not none.any() and one.any()
    calls = []

    def quadratic(points, which):
        calls.append(len(which))
        return (points ** 2).sum(1), 2 * points
    assert np.abs(S.minimise(quadratic, np.full((4, 3), 5.0), 2000, 1e-12)).max() < 1e-6 and len(calls) < 30


def plain_sigmoid(rows):
    n1, n0 = sum(t for _, t in rows), sum(not t for _, t in rows)
    a, b = 0.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(500):
        g, h = np.zeros(2), np.eye(2) * 1e-12
        for m, t in rows:
            t = (n1 + 1) / (n1 + 2) if t else 1 / (n0 + 2)
            p = 1 / (1 + math.exp(-(a * m + b)))
            g += (p - t) * np.array([m, 1.0])
            h += p * (1 - p) * np.outer([m, 1.0], [m, 1.0])
        step = np.linalg.solve(h, g)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    return a, b


def test_grouped_sigmoids_equal_plain_ones_in_few_jobs(spark):
    groups = {(f, k): [((i * 37 % 19 - 9) / 4 + k, (i * 37 % 19 + f > 9) ^ (i % 7 == 0)) for i in range(40 + f)] for f in range(3) for k in range(4)}
    groups[9, 0] = [(1.0, True)] * 5  # one class only
    rows = [(f, k, m, t) for (f, k), r in groups.items() for m, t in r]
    df = spark.createDataFrame(rows, "fold int, class int, m double, positive boolean").cache()
    df.count()
    spark.sparkContext.setJobGroup("sigmoids", "sigmoids")
    got = S.fit_sigmoids(df, ["fold", "class"])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("sigmoids")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(got) == set(groups) and len(jobs) <= 60
    for k, r in groups.items():
        if k != (9, 0):
            assert np.abs(np.array(got[k]) - plain_sigmoid(r)).max() < 1e-6


def test_members_and_saved_weights(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from cartable.operators.tfidf import feature_lists
    rows, y = data(33, n=66)
    long, labels = frames(spark, rows, y, [1.0] * 66)
    lists = feature_lists(long, labels)
    model = S.fit_calibrated_svm(lists, labels.withColumn("_cal_fold", (F.col("id") % 3).cast("int")), 3, 7, {"C": 1.0, "class_weight": "balanced"})
    model.to_frame(spark).write.parquet(tmpdir_path + "/m")
    again = S.CalibratedSvm.from_frame(spark.read.parquet(tmpdir_path + "/m"))
    score = lambda m: [tuple(r["p"]) for r in lists.select("id", m.probabilities(F.col("f"), F.col("v")).alias("p")).orderBy("id").collect()]
    p = score(model)
    assert p == score(again) and all(abs(sum(x) - 1) < 1e-9 for x in p)
    assert sum(max(range(3), key=lambda k: x[k]) == t for x, t in zip(p, y)) > 40
    n = [sum(t == k and i % 3 != 0 for i, t in enumerate(y)) for k in range(3)]
    x = dense_rows(rows, 7)
    weight = np.array([sum(n) / (3 * n[t]) * (i % 3 != 0) for i, t in enumerate(y)])
    want, _ = plain_svm(x, np.where(np.array(y) == 1, 1.0, -1.0), weight)
    assert np.abs(model.weights[0][1] - want).max() < 1e-4


def test_losses_read_runs_of_rows_and_sum_whole_batches(monkeypatch):
    rnd = np.random.default_rng(3)
    lengths = [3, 3, 3, 3, 25, 0, 1, 0] * 20
    ends = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
    f = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.sort(rnd.permutation(30)[:n]) for n in lengths]), pa.int32()))
    v = pa.ListArray.from_arrays(ends, pa.array(rnd.random(sum(lengths))))
    cols = [pa.array(rnd.integers(0, 3, len(lengths)), pa.int32()), pa.array(rnd.integers(0, 2, len(lengths)), pa.int32())]
    batch = pa.RecordBatch.from_arrays([*cols, f, v], ["y", "fold", "f", "v"]).slice(2)
    problems = [S.Problem(k, fold, (1.0, 2.0, 0.5)) for fold in (0, 1, None) for k in range(3)]
    w = rnd.normal(size=(len(problems), 31))
    packed = list(S._pack([batch]))
    whole = list(S._losses(w, problems, 1.5)(iter(packed)))
    monkeypatch.setattr(S, "HELD_CELLS", 10)
    runs = [b.num_rows for b in S._blocks(batch)]
    assert len(runs) > 20 and sum(runs) == batch.num_rows
    assert [b.to_pydict() for b in S._losses(w, problems, 1.5)(iter(packed))] == [b.to_pydict() for b in whole]
