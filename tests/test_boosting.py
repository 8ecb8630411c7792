"""Boosted trees against a plain booster, by the distributed and the grouped way."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartable.operators import boosting as B
from cartable.operators import histogram_trees as H


def data(seed, n=60, features=7, classes=3):
    """Sparse rows with ties, constant columns, an empty row, and labels that depend on the values."""
    rnd = random.Random(seed)
    rows, y = [], []
    for i in range(n):
        r = {f: rnd.choice([0.25, 0.5, 0.75, 1.0, round(rnd.random(), 2) + 0.01]) for f in range(features) if rnd.random() < 0.6}
        if i % 13 == 0:
            r = {}
        r.pop(features - 1, None) if i % 2 else r.__setitem__(features - 1, 0.5)
        rows.append(r)
        y.append((r.get(0, 0) > 0.5) + (classes > 2 and r.get(1, 0) > 0.6 and 1 in r) if rnd.random() < 0.85 else rnd.randrange(classes))
    return rows, [int(v) for v in y]


def plain_bins(rows):
    edges = {}
    for r in rows:
        for f, v in r.items():
            edges.setdefault(f, set()).add(v)
    edges = {f: sorted(v) for f, v in edges.items()}
    return [{f: edges[f].index(v) for f, v in r.items()} for r in rows], edges


def plain_split(bins, ids, g, h, p):
    """(-gain, feature, absent right, cut) by trying every partition of a node."""
    G, Hs, best = sum(g[i] for i in ids), sum(h[i] for i in ids), None
    l2, least = p.l2 * H.SCALE, p.min_hessian * H.SCALE
    part = lambda s: float(sum(g[i] for i in s)) ** 2 / (float(sum(h[i] for i in s)) + l2)
    for f in sorted({f for i in ids for f in bins[i]}):
        present = sorted({bins[i][f] for i in ids if f in bins[i]})
        for absent_right in (False, True) if p.learned_side else (False,):
            for cut in [-1, *present[:-1]] if not absent_right else present[:-1]:
                left = [i for i in ids if (bins[i][f] <= cut if f in bins[i] else not absent_right)]
                right = [i for i in ids if i not in set(left)]
                if absent_right and all(f in bins[i] for i in ids):
                    continue
                if min(len(left), len(right)) < max(p.min_rows, 1):
                    continue
                hl = sum(h[i] for i in left)
                if hl < least or Hs - hl < least or hl + l2 <= 0 or Hs - hl + l2 <= 0:
                    continue
                gain = part(left) + part(right) - (float(G) ** 2 / (float(Hs) + l2) if Hs + l2 > 0 else 0.0)
                if gain > 0 and (best is None or (-gain, f, absent_right, cut) < best[0]):
                    best = ((-gain, f, absent_right, cut), left, right)
    return best


def plain_boost(rows, y, w, classes, b):
    """Probabilities of the training rows, and the order of splits of each tree."""
    bins, _ = plain_bins(rows)
    n, p, outputs = len(rows), b.growth, 1 if classes == 2 else classes
    share = [sum(w[i] for i in range(n) if y[i] == k) / sum(w) for k in range(classes)]
    if b.init == "zero":
        m = [[0.0] * outputs for _ in range(n)]
    elif outputs == 1:
        m = [[math.log(share[1] / share[0])] for _ in range(n)]
    else:
        mean = sum(map(math.log, share)) / classes
        m = [[math.log(s) - mean for s in share] for _ in range(n)]
    curvature = b.curvature if b.curvature is not None else classes / (classes - 1)
    splits = []
    for _ in range(b.rounds):
        g, h = H.gradients(np.array(m), np.array(y), np.array(w, float), curvature)
        m = [list(x) for x in m]
        for o in range(outputs):
            go, ho = g[:, o].tolist(), h[:, o].tolist()
            leaves, order = [(list(range(n)), 0)], []
            open_ = [(plain_split(bins, ids, go, ho, p), ids, d) for ids, d in leaves if d < p.max_depth]
            done = []
            while True:
                able = [x for x in open_ if x[0] is not None]
                if not able or len(order) + 1 >= p.max_leaves:
                    break
                x = min(able, key=lambda x: x[0][0][0])
                open_.remove(x)
                (key, left, right), _, d = x
                order.append(key[1:])
                for ids in (left, right):
                    open_.append((plain_split(bins, ids, go, ho, p) if d + 1 < p.max_depth else None, ids, d + 1))
            done = [ids for _, ids, _ in open_]
            splits.append(order)
            for ids in done:
                below = sum(ho[i] for i in ids) + p.l2 * H.SCALE
                value = -b.learning_rate * sum(go[i] for i in ids) / below if below > 0 else 0.0
                for i in ids:
                    m[i][o] += value
    return H.probabilities(np.array(m)), splits


def frames(spark, rows, y, w):
    long = spark.createDataFrame([(i, f, v) for i, r in enumerate(rows) for f, v in r.items()], "id long, idx int, weight double")
    labels = spark.createDataFrame([(i, float(k), x) for i, (k, x) in enumerate(zip(y, w))], "id long, label_idx double, weight double")
    return long, labels


def scored(model, long, labels):
    from cartable.operators.tfidf import feature_lists
    rows = feature_lists(long, labels).select("id", model.probabilities(F.col("f"), F.col("v")).alias("p")).orderBy("id").collect()
    return np.array([r["p"] for r in rows])


CASES = {
    "gradient_boosting": B.Boosting(2, 0.3, "prior", 1.0, H.Growth(max_depth=3, max_leaves=6, min_rows=4)),
    "leaf_wise": B.Boosting(2, 0.3, "prior", None, H.Growth(max_depth=99, max_leaves=7, min_rows=2)),
    "second_order": B.Boosting(2, 0.3, "zero", 2.0, H.Growth(max_depth=3, min_rows=1, min_hessian=1.0, l2=1.0, learned_side=True)),
}


@pytest.mark.parametrize("kind", sorted(CASES))
@pytest.mark.parametrize("classes, group_cells", [(3, 1), (3, 150), (3, B.GROUP_CELLS), (2, 150)])
def test_equals_a_plain_booster(spark, kind, classes, group_cells):
    rows, y = data(classes, classes=classes)
    w = [1.0 + (k == 0) * 0.5 for k in y] if kind == "leaf_wise" else [1.0] * len(y)
    long, labels = frames(spark, rows, y, w)
    model = B.fit_boosted(long, labels, classes, CASES[kind], group_cells)
    want, splits = plain_boost(rows, y, w, classes, CASES[kind])
    trees = [t for r in model.rounds for t in r]
    assert [int((t.left >= 0).sum()) for t in trees] == [len(s) for s in splits]
    assert [sorted((int(f), not a) for f, a, lo in zip(t.feature, t.absent_left, t.left) if lo >= 0) for t in trees] == [
        sorted((f, a) for f, a, _ in s) for s in splits]
    assert np.abs(scored(model, long, labels) - want).max() < 1e-9


def test_leaf_wise_order_takes_the_best_leaf_first():
    """A budget of k leaves gives the first k - 1 splits of the unlimited order."""
    rows, y = data(11, n=200)
    bins, _ = plain_bins(rows)
    offsets = np.cumsum([0, *[len(b) for b in bins]])
    f = np.array([k for b in bins for k in sorted(b)])
    v = np.array([b[k] for b in bins for k in sorted(b)])
    g, h = H.gradients(np.zeros((200, 3)), np.array(y), np.ones(200), 1.5)
    full = H.grow(offsets, f, v, g[:, 0], h[:, 0], H.Growth(max_depth=99, min_rows=3), 0)
    gains = sorted(-n[2] for n in full if n[0] >= 0)
    assert len(gains) > 10
    for leaves in (2, 3, 5, 9):
        part = H.grow(offsets, f, v, g[:, 0], h[:, 0], H.Growth(max_depth=99, min_rows=3, max_leaves=leaves), 0)
        chosen = [-n[2] for n in part if n[0] >= 0]
        assert len(chosen) == leaves - 1
        # No leaf that was left open has a better split than the last one taken.
        reach, open_ = [], [0]
        for _ in range(leaves - 1):
            best = max(open_, key=lambda i: -full[i][2] if full[i][0] >= 0 else -1)
            reach.append(-full[best][2])
            open_.remove(best)
            open_ += full[best][:2]
        assert sorted(chosen) == sorted(reach)


def test_a_wide_row_does_not_send_few_values_through_aggregates(spark, monkeypatch):
    """What a task holds are the values of its rows, not rows times the widest row."""
    rows, y = data(7)
    rows[0] = {f: 0.5 for f in range(40)}
    cells = sum(len(r) for r in rows)
    assert cells < 400 < len(rows) * 40
    long, labels = frames(spark, rows, y, [1.0] * len(y))
    want, _ = plain_boost(rows, y, [1.0] * len(y), 3, CASES["leaf_wise"])
    monkeypatch.setattr(B, "level_splits", None)
    got = scored(B.fit_boosted(long, labels, 3, CASES["leaf_wise"], group_cells=400), long, labels)
    assert np.abs(got - want).max() < 1e-9


@pytest.mark.parametrize("learned_side", [False, True])
def test_entries_judged_in_parts_give_the_same_tree(monkeypatch, learned_side):
    rows, y = data(12, n=150)
    bins, _ = plain_bins(rows)
    offsets = np.cumsum([0, *[len(b) for b in bins]])
    f = np.array([k for b in bins for k in sorted(b)], np.int32)
    v = np.array([b[k] for b in bins for k in sorted(b)], np.int32)
    g, h = H.gradients(np.zeros((150, 3)), np.array(y), np.ones(150), 1.5)
    p = H.Growth(max_depth=5, max_leaves=12, min_rows=2, learned_side=learned_side)
    whole = H.grow(offsets, f, v, g[:, 0], h[:, 0], p, 0)
    root = plain_split(bins, list(range(150)), g[:, 0].tolist(), h[:, 0].tolist(), p)
    assert whole[0][2:6] == root[0]
    for chunk in (1, 10, 100):
        monkeypatch.setattr(H, "CHUNK", chunk)
        assert H.grow(offsets, f, v, g[:, 0], h[:, 0], p, 0) == whole


def test_written_margins_and_long_runs_agree(spark, monkeypatch):
    rows, y = data(5)
    long, labels = frames(spark, rows, y, [1.0] * len(y))
    b = B.Boosting(7, 0.2, "prior", 1.0, H.Growth(max_depth=2, max_leaves=4, min_rows=3))
    whole = scored(B.fit_boosted(long, labels, 3, b), long, labels)
    monkeypatch.setattr(B, "REFRESH", 2)
    assert (scored(B.fit_boosted(long, labels, 3, b), long, labels) == whole).all()


def test_saved_nodes_give_the_same_scores(spark, tmpdir_path):
    rows, y = data(6)
    long, labels = frames(spark, rows, y, [1.0] * len(y))
    model = B.fit_boosted(long, labels, 3, CASES["second_order"])
    model.to_frame(spark).write.parquet(tmpdir_path + "/m")
    again = B.BoostedTrees.from_frame(spark.read.parquet(tmpdir_path + "/m"), 3)
    assert again.learned_side and (scored(again, long, labels) == scored(model, long, labels)).all()


def test_no_split_and_no_features(spark):
    """Without a useful split every row keeps the class shares."""
    long, labels = frames(spark, [{}] * 6, [0, 0, 0, 1, 1, 2], [1.0] * 6)
    model = B.fit_boosted(long, labels, 3, CASES["gradient_boosting"])
    assert np.abs(scored(model, long, labels) - [0.5, 1 / 3, 1 / 6]).max() < 1e-6


def test_presets_keep_rounds_depth_and_leaves():
    from cartable.plans import jobs as J
    spec = lambda name: J.PRESETS[name]["model"]
    got = {n: B.boosting_params(spec(n)["type"], spec(n)["params"]) for n in ("tfidf_gradient_boosting", "lightgbm", "xgboost")}
    assert {n: (b.rounds, b.learning_rate) for n, b in got.items()} == dict.fromkeys(got, (300, 0.1))
    assert got["tfidf_gradient_boosting"].growth.max_depth == got["xgboost"].growth.max_depth == 6
    assert got["lightgbm"].growth.max_leaves == 63 and got["lightgbm"].growth.max_depth > 1000
    assert got["xgboost"].growth.learned_side and got["xgboost"].growth.l2 == 1.0
    with pytest.raises(ValueError):
        B.boosting_params("boost", {})
