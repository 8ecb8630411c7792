"""Random forest of any depth: both phases against a plain forest."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartable.operators import forest as R
from cartable.operators.tfidf import feature_lists
from tests.test_boosting import data, frames, plain_bins


def row_keys(spark, n):
    return {r["id"]: r["k"] for r in spark.range(n).select("id", F.xxhash64("id").alias("k")).collect()}


def plain_tree(bins, ids, y, w, classes, key, depth, p, scale):
    """Nested tuples: class weights, or (feature, cut, left, right)."""
    total = [sum(w[i] for i in ids if y[i] == k) for k in range(classes)]
    if depth >= p.max_depth or sum(t > 0 for t in total) < 2 or len(ids) < 2 * p.min_rows:
        return total
    features = sorted({f for i in ids for f in bins[i]})
    draw = dict(zip(features, R.draws(np.array(features), key, scale).tolist())) if features else {}
    for d in sorted(set(draw.values())):
        best = None
        for f in (f for f in features if draw[f] == d):
            for cut in [-1, *sorted({bins[i][f] for i in ids if f in bins[i]})[:-1]]:
                left = [i for i in ids if bins[i].get(f, -1) <= cut]
                right = [i for i in ids if bins[i].get(f, -1) > cut]
                if min(len(left), len(right)) < p.min_rows:
                    continue
                score = 0.0
                for side in (left, right):
                    s = [sum(w[i] for i in side if y[i] == k) for k in range(classes)]
                    score += sum(float(x) * float(x) for x in s) / float(sum(s))
                if best is None or (-score, f, cut) < best[0]:
                    best = ((-score, f, cut), left, right)
        if best:
            (_, f, cut), left, right = best
            return (f, cut, plain_tree(bins, left, y, w, classes, R.child_key(key, False), depth + 1, p, scale),
                    plain_tree(bins, right, y, w, classes, R.child_key(key, True), depth + 1, p, scale))
    return total


def plain_forest(rows, y, w, classes, features, p, keys):
    bins, _ = plain_bins(rows)
    m = int(features ** 0.5) if p.max_features == "sqrt" else features
    whole = [round(x * R.WEIGHT) for x in w]
    probs = np.zeros((len(rows), classes))
    for t in range(p.trees):
        key = R.root_key(p.seed, t)
        count = R.bootstrap(np.array([keys[i] for i in range(len(rows))]), key)
        tree = plain_tree(bins, [i for i in range(len(rows)) if count[i]], y, [int(c) * x for c, x in zip(count, whole)], classes, key, 0, p,
                          max(1.0, features / m))
        for i, b in enumerate(bins):
            at = tree
            while isinstance(at, tuple):
                at = at[2] if b.get(at[0], -1) <= at[1] else at[3]
            probs[i] += np.array(at, float) / (sum(at) or 1)
    return probs / p.trees


def scored(model, long, labels, **kw):
    rows = {r["id"]: r["proba"] for r in model.predict(feature_lists(long, labels), **kw).collect()}
    return np.array([rows[i] for i in sorted(rows)])


@pytest.mark.parametrize("group_cells, rows_per_batch", [(10 ** 9, 10 ** 9), (150, 180), (20, 10 ** 9)])
@pytest.mark.parametrize("max_features", ["sqrt", None])
def test_equals_a_plain_forest(spark, group_cells, rows_per_batch, max_features):
    rows, y = data(21, n=60, features=9)
    w = [1.0 + 0.37 * (k == 1) for k in y]
    long, labels = frames(spark, rows, y, w)
    p = R.Forest(trees=4, max_features=max_features, seed=7)
    want = plain_forest(rows, y, w, 3, 9, p, row_keys(spark, 60))
    model = R.fit_forest(long, labels, 3, 9, p, group_cells, rows_per_batch)
    assert np.abs(scored(model, long, labels) - want).max() < 1e-12
    if group_cells == 150:
        assert any(len(t) > 1 for t in model.tops)
        assert np.abs(scored(model, long, labels, broadcast_nodes=0) - want).max() < 1e-12
    model.release()


def test_whole_trees_share_their_rows(spark, monkeypatch):
    """Trees whose rows fit a task are grown from rows that are sent once for several
    trees, and one wide row does not make the others wide."""
    rows, y = data(22, n=60, features=9)
    rows[0] = {f: 0.5 for f in range(40)}
    long, labels = frames(spark, rows, y, [1.0] * len(y))
    p = R.Forest(trees=30, seed=3)
    want = plain_forest(rows, y, [1.0] * len(y), 3, 40, p, row_keys(spark, 60))
    monkeypatch.setattr(R, "_spread", None)  # a copy of the rows for every tree
    model = R.fit_forest(long, labels, 3, 40, p, group_cells=400)
    assert [len(t) for t in model.tops] == [1] * 30
    assert np.abs(scored(model, long, labels) - want).max() < 1e-12
    model.release()


def test_chain_deeper_than_any_fixed_limit(spark):
    """Every row has a feature of its own, so a split takes one row off: only a chain separates them."""
    n = 200
    rows = [{i: 1.0} for i in range(n)]
    y = [i % 2 for i in range(n)]
    long, labels = frames(spark, rows, y, [1.0] * n)
    for cells in (10 ** 9, n // 2):
        model = R.fit_forest(long, labels, 2, n, R.Forest(trees=2, max_features=None), group_cells=cells)
        depth = {}
        for r in model.subtrees.orderBy("slot", "node").collect():
            d = depth.setdefault((r["slot"], r["node"]), 0)
            for c in (r["left"], r["right"]):
                if c >= 0:
                    depth[r["slot"], c] = d + 1
        if cells == 10 ** 9:
            assert max(depth.values()) > 30
        p = scored(model, long, labels)
        # A tree knows the rows of its sample, nearly two thirds of all.
        assert (p.argmax(1) == y).mean() > 0.7


def test_depth_limit_shared_folder_and_empty_features(spark):
    rnd = random.Random(4)
    rows, y = [{}] * 9, [rnd.randrange(2) for _ in range(9)]
    long, labels = frames(spark, rows, y, [1.0] * 9)
    p = scored(R.fit_forest(long, labels, 2, 5, R.Forest(trees=2)), long, labels)
    assert p.shape == (9, 2) and np.allclose(p, p[0])
    rows, y = data(3)
    long, labels = frames(spark, rows, y, [1.0] * len(y))
    model = R.fit_forest(long, labels, 3, 7, R.Forest(trees=3, max_depth=1))
    assert model.size <= 9
    assert R.forest_params({"max_depth": None, "n_estimators": 300}).max_depth > 10 ** 6
