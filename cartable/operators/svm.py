"""Linear SVM with squared hinge loss (M02) and grouped Platt calibration.

All problems - one per calibration fold and class - are solved together: each
evaluation is one aggregate over the rows that returns every problem's loss and
gradient, and the driver runs one L-BFGS per problem on them in step. Rows are kept
as packed blocks, so an evaluation copies bytes to the tasks, not list entries. A
problem's sums pass over the values of the fold it leaves out, and its gradient over
rows outside the margin: their terms are zero, and the others keep their order. The
intercept is a weight of its own, regularised like the others. Weights are bounded
by the features times the problems; gradients of many partitions are added up by
feature blocks before they reach the driver.

Sigmoids of all (fold, class) pairs are fitted by Newton steps on Platt's smoothed
targets, one grouped aggregate of a few sums per step for all of them.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import SharedTables, ship
from . import histogram_trees as H
from .models import sized_partitions

BLOCK = 1 << 14        # features of a block in the sum of gradients
DIRECT_PARTITIONS = 8  # so many partial gradients go to the driver unsummed
MEMORY = 10            # pairs kept by L-BFGS
HELD_CELLS = 1 << 18   # feature values a task unpacks at a time; its arrays are a few times as long


@dataclass(frozen=True)
class Problem:
    """One-vs-rest for ``label`` on the rows outside ``fold`` (None: all rows)."""
    label: int
    fold: int | None
    class_weights: tuple


def minimise(evaluate: Callable, w: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS on every row of ``w`` at once. ``evaluate(points, which)`` gives losses
    and gradients of the problems in ``which``. A problem is done when its largest
    gradient component is below ``tol`` times the first one's (or one)."""
    n = len(w)
    f, g = evaluate(w, np.arange(n))
    first = np.maximum(np.abs(g).max(1), 1.0)
    pairs: list[list] = [[] for _ in range(n)]
    step, iters = np.ones(n), np.zeros(n, int)
    direction = np.zeros_like(w)
    active = [p for p in range(n) if np.abs(g[p]).max() > tol * first[p]] if max_iter > 0 else []

    def aim(p):
        q, alphas = g[p].copy(), []
        for s, y, rho in reversed(pairs[p]):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if pairs[p]:
            s, y, _ = pairs[p][-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs[p], reversed(alphas)):
            q += (a - rho * (y @ q)) * s
        direction[p] = -q
        step[p] = 1.0 if pairs[p] else min(1.0, 1.0 / max(np.abs(g[p]).sum(), 1e-300))

    for p in active:
        aim(p)
    while active:
        which = np.array(active)
        trial = w[which] + step[which, None] * direction[which]
        ft, gt = evaluate(trial, which)
        for i, p in enumerate(active[:]):
            slope = direction[p] @ g[p]
            if not ft[i] <= f[p] + 1e-4 * step[p] * slope:
                step[p] *= 0.5
                if step[p] < 1e-16:
                    active.remove(p)
                continue
            s, y = trial[i] - w[p], gt[i] - g[p]
            if s @ y > 1e-14 * (y @ y):
                pairs[p] = [*pairs[p], (s, y, 1.0 / (s @ y))][-MEMORY:]
            w[p], f[p], g[p] = trial[i], ft[i], gt[i]
            iters[p] += 1
            if iters[p] >= max_iter or np.abs(g[p]).max() <= tol * first[p]:
                active.remove(p)
            else:
                aim(p)
    return w


def _csr(batch):
    (offsets, f), (_, v) = H.lists(batch.column("f")), H.lists(batch.column("v"))
    return np.repeat(np.arange(batch.num_rows), np.diff(offsets)), f, v


def _margins(batch, w: np.ndarray) -> np.ndarray:
    """(problems, rows): weights in the columns, the intercept last."""
    row, f, v = _csr(batch)
    return np.stack([np.bincount(row, v * x[f], batch.num_rows) + x[-1] for x in w]) if len(w) else np.zeros((0, batch.num_rows))


_PACKED_TYPES = {"y": np.int32, "fold": np.int32, "length": np.int32, "f": np.int32, "v": np.float64}
_PACKED = ", ".join(f"{name} binary" for name in _PACKED_TYPES)


def _pack(batches):
    """Task: a batch of rows ``(y, fold, f, v)`` as one row, each column as bytes."""
    for batch in batches:
        if batch.num_rows:
            (offsets, f), (_, v) = H.lists(batch.column("f")), H.lists(batch.column("v"))
            columns = (batch.column("y").to_numpy(), batch.column("fold").to_numpy(), np.diff(offsets), f, v)
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary())
                                              for x, t in zip(columns, _PACKED_TYPES.values())], list(_PACKED_TYPES))


def _unpacked(batches):
    """``(y, fold, length, f, v)`` of every packed batch, read where they lie."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(np.frombuffer(batch.column(n)[i].as_buffer(), t) for n, t in _PACKED_TYPES.items())


def _runs(ends: np.ndarray):
    """Runs of rows with at most ``HELD_CELLS`` feature values, or one row; ``ends``: where
    the rows' values begin, and the last one's end."""
    at = 0
    while at < len(ends) - 1:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + HELD_CELLS, "right")) - 1)
        yield at, stop
        at = stop


def _blocks(batch):
    """A batch in such runs."""
    for a, b in _runs(batch.column("f").offsets.to_numpy()):
        yield batch.slice(a, b - a)


def _losses(w: np.ndarray, problems: list[Problem], c: float):
    """Task: a partition's losses and gradients, by blocks of features. A batch's values are
    read in runs of rows, so what a task makes of them does not follow the batch; its sums
    are those of the whole batch, in the order of its values."""
    size = w.shape[1]

    def cells(ends, length, f, v):
        for a, b in _runs(ends):
            yield a, b, np.repeat(np.arange(b - a), length[a:b]), f[ends[a]:ends[b]].astype(np.intp), v[ends[a]:ends[b]]

    def work(batches):
        grad, loss, some = np.zeros((len(problems), size)), np.zeros(len(problems)), False
        for y, fold, length, f, v in _unpacked(batches):
            some, ends = True, np.r_[0, np.cumsum(length)]
            pull = np.empty((len(problems), len(y)))
            for a, b, row, fs, vs in cells(ends, length, f, v):
                for left_out in {p.fold for p in problems}:
                    at = slice(None) if left_out is None else np.flatnonzero((fold[a:b] != left_out)[row])
                    r, fr, vr = row[at], fs[at], vs[at]
                    for i, p in enumerate(problems):
                        if p.fold == left_out:
                            pull[i, a:b] = np.bincount(r, vr * w[i][fr], b - a) + w[i, -1]
            for i, p in enumerate(problems):  # margins become pulls
                sign = np.where(y == p.label, 1.0, -1.0)
                short = np.maximum(1.0 - sign * pull[i], 0.0)
                weight = c * np.array(p.class_weights)[y] * (True if p.fold is None else fold != p.fold)
                loss[i] += (weight * short * short).sum()
                pull[i] = -2.0 * weight * sign * short
            part = np.zeros_like(grad)
            for a, b, row, fs, vs in cells(ends, length, f, v):
                for i in range(len(problems)):
                    at = np.flatnonzero((pull[i, a:b] != 0)[row])
                    np.add.at(part[i], fs[at], vs[at] * pull[i, a:b][row[at]])
            grad += part
            grad[:, -1] += pull.sum(1)
        if some:
            yield _block_rows([-1] + list(range(0, size, BLOCK)), [loss] + [grad[:, i:i + BLOCK] for i in range(0, size, BLOCK)])
    return work


def _block_rows(blocks, arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())],
                                      ["block", "part"])


def _sum_blocks(batches):
    sums: dict = {}
    for batch in batches:
        for block, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()):
            part = np.frombuffer(part)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield _block_rows(list(sums), list(sums.values()))


def solve(rows: DataFrame, problems: list[Problem], features: int, c: float, max_iter: int, tol: float = 1e-6,
          packed_once: Callable = lambda: None) -> np.ndarray:
    """Weights (problems, features + 1) over ``rows(y, fold, f, v)``, a kept frame,
    packed once (then ``packed_once`` is called): minimum of |w|^2 / 2 + c * sum of weight * max(0, 1 - margin)^2."""
    packed = rows.mapInArrow(_pack, _PACKED).persist(StorageLevel.MEMORY_AND_DISK)
    packed.count()
    packed_once()
    many = packed.rdd.getNumPartitions() > DIRECT_PARTITIONS

    def evaluate(w, which):
        some = [problems[p] for p in which]
        parts = packed.mapInArrow(_losses(w, some, c), "block int, part binary")
        if many:
            parts = parts.repartition("block").mapInArrow(_sum_blocks, "block int, part binary")
        loss, grad = np.zeros(len(which)), np.zeros_like(w)
        for r in parts.collect():  # features x problems numbers (of each partition, if these are few)
            part = np.frombuffer(r["part"]).reshape(len(which), -1)
            if r["block"] < 0:
                loss += part[:, 0]
            else:
                grad[:, r["block"]:r["block"] + part.shape[1]] += part
        return loss + 0.5 * (w * w).sum(1), grad + w
    try:
        return minimise(evaluate, np.zeros((len(problems), features + 1)), max_iter, tol)
    finally:
        packed.unpersist()


# ---------------------------------------------------------------- sigmoids
def fit_sigmoids(margins: DataFrame, groups: list[str], max_steps: int = 100) -> dict:
    """``{group: (a, b)}`` of sigmoid(a * m + b) for every group of ``margins(*groups, m,
    positive)``, on Platt's targets (N+ + 1) / (N+ + 2) and 1 / (N- + 2). Newton steps
    with halving; one aggregate per step serves all groups. Groups are few."""
    key = lambda r: tuple(r[g] for g in groups)
    pos = F.sum(F.col("positive").cast("long"))
    counts = {key(r): (r["p"], r["n"] - r["p"]) for r in margins.groupBy(*groups).agg(pos.alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    at = {k: (0.0, math.log((p + 1.0) / (n + 1.0))) for k, (p, n) in counts.items()}
    best: dict = {}          # group -> (loss, (a, b), gradient, Hessian) of the accepted point
    out, spark = {}, margins.sparkSession
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in margins.schema if f.name in groups)
    for _ in range(max_steps):
        if not at:
            break
        points = spark.createDataFrame([(*k, a, b, (counts[k][0] + 1.0) / (counts[k][0] + 2.0), 1.0 / (counts[k][1] + 2.0))
                                        for k, (a, b) in at.items()], f"{types}, a double, b double, hi double, lo double")
        z = F.col("a") * F.col("m") + F.col("b")
        t = F.when(F.col("positive"), F.col("hi")).otherwise(F.col("lo"))
        p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
        x = margins.join(F.broadcast(points), groups).select(*groups, "m", (F.greatest(z, F.lit(0.0)) - t * z + F.log1p(F.exp(-F.abs(z)))).alias("l"),
                                                             (p - t).alias("d"), (p * (1 - p)).alias("h"))
        sums = x.groupBy(*groups).agg(*[F.sum(e).alias(n) for n, e in (
            ("l", F.col("l")), ("ga", F.col("d") * F.col("m")), ("gb", F.col("d")), ("haa", F.col("h") * F.col("m") * F.col("m")),
            ("hab", F.col("h") * F.col("m")), ("hbb", F.col("h")))])
        for r in sums.collect():  # one row per group
            k, point = key(r), at[key(r)]
            if k in best and not r["l"] <= best[k][0]:
                a0, b0 = best[k][1]
                at[k] = ((point[0] + a0) / 2, (point[1] + b0) / 2)
                if abs(at[k][0] - a0) + abs(at[k][1] - b0) < 1e-12:
                    out[k] = best[k][1]
                    del at[k]
                continue
            best[k] = (r["l"], point)
            haa, hbb, hab = r["haa"] + 1e-12, r["hbb"] + 1e-12, r["hab"]
            det = haa * hbb - hab * hab
            da, db = (hbb * r["ga"] - hab * r["gb"]) / det, (haa * r["gb"] - hab * r["ga"]) / det
            if abs(da) + abs(db) < 1e-9 * (1 + abs(point[0]) + abs(point[1])):
                out[k] = point
                del at[k]
            else:
                at[k] = (point[0] - da, point[1] - db)
    return out | {k: best[k][1] for k in at if k in best}


def fit_platt(scored: DataFrame, margin: Column, positive: Column) -> tuple[float, float]:
    """``(a, b)`` of one sigmoid(a * margin + b) on Platt's targets."""
    rows = scored.select(F.lit(0).alias("g"), margin.cast("double").alias("m"), positive.alias("positive")).persist()
    out = fit_sigmoids(rows, ["g"])[0,]
    rows.unpersist()
    return out


# ------------------------------------------------------------------- model
class CalibratedSvm:
    """Members (one per fold): weights (classes, features + 1) and a sigmoid per class."""

    def __init__(self, weights: list[np.ndarray], sigmoids: list[list[tuple[float, float]]]):
        self.weights, self.sigmoids = weights, sigmoids

    def probabilities(self, features: Column, values: Column) -> Column:
        """Mean over the members of their sigmoids, rows normalised to one."""
        ship(SparkSession.active())
        w, sig = self.weights, [np.array(s) for s in self.sigmoids]

        def some(batch):
            total = 0.0
            for x, s in zip(w, sig):
                p = 1.0 / (1.0 + np.exp(-(s[:, :1] * _margins(batch, x) + s[:, 1:])))
                whole = p.sum(0)
                total = total + np.where(whole > 0, p / np.where(whole > 0, whole, 1.0), 1.0 / len(p))
            return (total / len(w)).T

        def score(f: pa.Array, v: pa.Array) -> pa.Array:
            parts = [some(b) for b in _blocks(pa.RecordBatch.from_arrays([f, v], ["f", "v"]))]
            p = np.ascontiguousarray(np.concatenate(parts) if parts else np.zeros((0, 1)))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

        return F.arrow_udf(score, "array<double>")(features, values)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per class and member: its sigmoid and its weights."""
        return spark.createDataFrame([(i, k, float(a), float(b), w[k].tolist()) for i, (w, s) in enumerate(zip(self.weights, self.sigmoids))
                                      for k, (a, b) in enumerate(s)], "member int, class int, a double, b double, weights array<double>")

    @staticmethod
    def from_frame(df: DataFrame) -> "CalibratedSvm":
        members: dict = {}
        for r in sorted(df.collect(), key=lambda r: (r["member"], r["class"])):  # members x classes
            members.setdefault(r["member"], []).append(r)
        return CalibratedSvm([np.array([r["weights"] for r in m]) for m in members.values()], [[(r["a"], r["b"]) for r in m] for m in members.values()])


def fit_calibrated_svm(lists: DataFrame, labels: DataFrame, classes: int, features: int, params: dict, folds: int = 3,
                       tol: float = 1e-6) -> CalibratedSvm:
    """``lists(id, f, v)`` and ``labels(id, label_idx, _cal_fold)``. Each member is
    fitted outside its fold (class weights of those rows alone, if balanced) and its
    sigmoids inside."""
    spark = lists.sparkSession
    ship(spark)
    aside = SharedTables(spark, "svm")
    rows = aside.write(labels.select("id", F.col("label_idx").cast("int").alias("y"), F.col("_cal_fold").cast("int").alias("fold"))
                       .join(lists, "id").drop("id"), "rows").persist(StorageLevel.MEMORY_AND_DISK)
    count = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}  # folds x classes
    problems = []
    for fold in range(folds):
        n = [sum(c for (f, y), c in count.items() if f != fold and y == k) for k in range(classes)]
        present = sum(x > 0 for x in n)
        cw = tuple(sum(n) / (present * x) if x else 0.0 for x in n) if params.get("class_weight") == "balanced" else (1.0,) * classes
        problems += [Problem(k, fold, cw) for k in range(classes)]
    kept = sized_partitions(rows)
    # Once packed, the rows are read again only for the sigmoids, from where they were written.
    w = solve(kept, problems, features, float(params.get("C", 1.0)), int(params.get("max_iter", 1000)), tol, rows.unpersist)

    def held_out(batches):
        for batch in (part for whole in batches for part in _blocks(whole)):
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            m = _margins(batch, w)
            for i, p in enumerate(problems):
                at = np.flatnonzero(fold == p.fold)
                if at.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, i, np.int32)), pa.array(m[i, at]), pa.array(y[at] == p.label)],
                                                     ["problem", "m", "positive"])

    margins = kept.mapInArrow(held_out, "problem int, m double, positive boolean").persist(StorageLevel.MEMORY_AND_DISK)
    sig = fit_sigmoids(margins, ["problem"])
    margins.unpersist()
    aside.drop(rows)
    return CalibratedSvm([w[f * classes:(f + 1) * classes] for f in range(folds)],
                         [[sig.get((f * classes + k,), (0.0, 0.0)) for k in range(classes)] for f in range(folds)])
