"""Gradient-boosted trees for several classes (M05, M06, M07) as Spark jobs.

Features are binned once. A round grows one tree per output (one per class, a
single one for two classes) on the gradients of the rounds before:

* a node of too many rows is split by one aggregate over (output, node, feature,
  bin) for all nodes of all trees at once; zero (absent) values need no cells,
  their sums are the node's less the feature's;
* a node whose rows fit ``GROUP_CELLS`` feature values is finished in one grouped
  task, so small data and the lower levels of large trees cost one job.

Both give the same split (sums are whole numbers, ties have one order). Trees grow
best-first under a leaf budget: children of every leaf that may still be split are
judged in one job, then the best-first order is replayed on the driver, which
holds nodes, never rows. Rows carry the margins of the last written state; the
trees since then are applied in the tasks. Every ``REFRESH`` rounds the margins are
written to the shared folder, so a lost executor repeats a few rounds' trees.
"""
from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..session import SharedTables, ship
from . import histogram_trees as H
from .models import sized_partitions

MAX_BINS = 255
GROUP_CELLS = 8_000_000   # feature values of a node that one task may hold, about 50 bytes each
REFRESH = 10              # rounds between written margins


@dataclass(frozen=True)
class Boosting:
    """``init``: "prior" starts from the class shares, "zero" from equal margins.
    ``curvature`` multiplies p (1 - p) of three and more classes; None: K / (K - 1)."""
    rounds: int = 100
    learning_rate: float = 0.1
    init: str = "prior"
    curvature: float | None = 1.0
    growth: H.Growth = H.Growth()


def boosting_params(kind: str, params: dict) -> Boosting:
    """The parameters of a preset, with the defaults of the library it is written for."""
    rounds = int(params.get("max_iter", params.get("n_estimators", 100)))
    rate = float(params.get("learning_rate", 0.3 if kind == "xgboost" else 0.1))
    depth = params.get("max_depth")
    unlimited = 1 << 30
    if kind == "gradient_boosting":
        g = H.Growth(max_depth=int(depth or unlimited), max_leaves=int(params.get("max_leaf_nodes") or 31),
                     min_rows=int(params.get("min_samples_leaf", 20)), l2=float(params.get("l2_regularization", 0.0)))
        return Boosting(rounds, rate, "prior", 1.0, g)
    if kind == "lightgbm":
        g = H.Growth(max_depth=int(depth) if depth and int(depth) > 0 else unlimited, max_leaves=int(params.get("num_leaves", 31)),
                     min_rows=int(params.get("min_child_samples", 20)), min_hessian=float(params.get("min_child_weight", 1e-3)),
                     l2=float(params.get("reg_lambda", 0.0)))
        return Boosting(rounds, rate, "prior", None, g)
    if kind == "xgboost":
        g = H.Growth(max_depth=int(6 if depth is None else depth) or unlimited, max_leaves=int(params.get("max_leaves") or unlimited), min_rows=1,
                     min_hessian=float(params.get("min_child_weight", 1.0)), l2=float(params.get("reg_lambda", 1.0)), learned_side=True)
        return Boosting(rounds, rate, "zero", 2.0, g)
    raise ValueError(f"unknown boosting kind {kind!r}")


# ---------------------------------------------------------------- binning
def feature_edges(long: DataFrame, idx: str = "idx", value: str = "weight", bins: int = MAX_BINS, min_rows: int = 1) -> DataFrame:
    """``(idx, edges)``: upper edges of the bins of each feature's present values,
    quantiles that are values themselves. A feature with at most ``bins`` present
    values keeps every one of them. One side of any split holds present values only,
    so a feature present in fewer than ``min_rows`` rows can never split and is left out."""
    cuts = [i / bins for i in range(1, bins + 1)]
    edges = long.groupBy(F.col(idx).cast("int").alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.percentile_approx(value, cuts, 10000))).alias("edges"))
    return edges.where(F.col("n") >= min_rows).drop("n")


def binned_rows(long: DataFrame, labels: DataFrame, edges: DataFrame, idx: str = "idx", value: str = "weight", keep=()) -> DataFrame:
    """``(*keep, y, w, f, b)`` per row of ``labels(id, label_idx, weight)``: its features
    and the bins of their values (number of edges below the value)."""
    bin_of = lambda v: F.size(F.filter("edges", lambda e: e < v))
    cells = (long.select("id", F.col(idx).cast("int").alias("idx"), F.col(value).cast("double").alias("_v")).join(edges, "idx")
             .select("id", F.struct("idx", bin_of(F.col("_v")).alias("bin")).alias("c")))
    rows = cells.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    none = F.array().cast("array<int>")
    return labels.join(rows, "id", "left").select(
        *keep, F.col("label_idx").cast("int").alias("y"), F.col("weight").cast("double").alias("w"),
        F.coalesce("c.idx", none).alias("f"), F.coalesce("c.bin", none).alias("b"))


# ------------------------------------------------------------------ model
@dataclass
class BoostedTrees:
    """Rounds of trees whose cuts are feature values, and the starting margins."""
    classes: int
    start: list[float]
    rounds: list[list[H.Tree]]
    learned_side: bool = False

    def probabilities(self, features: Column, values: Column) -> Column:
        """Class probabilities of rows given as two parallel lists."""
        ship(SparkSession.active())
        start, rounds = np.array(self.start), self.rounds
        used = H.used_features([t for trees in rounds for t in trees])

        def score(f: pa.Array, v: pa.Array) -> pa.Array:
            offsets, feature = H.lists(f)
            value, out = H.lists(v)[1], []
            for i in range(0, len(offsets) - 1, 1024):  # a slice of rows times the features in use
                o = offsets[i:i + 1025]
                x = H.dense(o - o[0], feature[o[0]:o[-1]], value[o[0]:o[-1]], used, np.nan, float)
                out.append(H.probabilities(H.add_trees(np.tile(start, (len(o) - 1, 1)), x, used, rounds)))
            p = np.concatenate(out) if out else np.zeros((0, 1))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

        return F.arrow_udf(score, "array<double>")(features, values)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per node, and one per starting margin (round -1)."""
        rows = [(-1, o, 0, -1, float(len(self.start)), self.learned_side, -1, -1, float(m)) for o, m in enumerate(self.start)]
        for r, trees in enumerate(self.rounds):
            for o, t in enumerate(trees):
                rows += [(r, o, i, int(t.feature[i]), float(t.cut[i]), bool(t.absent_left[i]), int(t.left[i]), int(t.right[i]),
                          float(t.value[i])) for i in range(len(t.left))]
        return spark.createDataFrame(rows, "round int, output int, node int, feature int, cut double, absent_left boolean, "
                                           "`left` int, `right` int, value double")

    @staticmethod
    def from_frame(df: DataFrame, classes: int) -> "BoostedTrees":
        rows = sorted(df.collect(), key=lambda r: (r["round"], r["output"], r["node"]))  # bounded: rounds x outputs x leaves
        head = [r for r in rows if r["round"] < 0]
        trees: dict = {}
        for r in rows:
            if r["round"] >= 0:
                trees.setdefault(r["round"], {}).setdefault(r["output"], []).append(
                    (r["feature"], r["cut"], r["absent_left"], r["left"], r["right"], r["value"]))
        return BoostedTrees(classes, [r["value"] for r in head], [[H.Tree.of(t[o]) for o in sorted(t)] for _, t in sorted(trees.items())],
                            bool(head[0]["absent_left"]))


# --------------------------------------------------------------- training
class _Node:
    """A node on the driver. ``split`` is None while unknown, () if there is none."""
    __slots__ = ("depth", "total", "split", "left", "right")

    def __init__(self, depth: int, total=None, split=None):
        self.depth, self.total, self.split, self.left, self.right = depth, total, split, -1, -1


class _Growing:
    """One output's tree while it grows."""

    def __init__(self, total=None):
        self.nodes = [_Node(0, total)]

    def children(self, i: int, p: H.Growth) -> None:
        n = self.nodes[i]
        if n.left < 0:
            lt, (g, h, c) = n.split[4:], n.total
            for t in (lt, (g - lt[0], h - lt[1], c - lt[2])):
                done = n.depth + 1 >= p.max_depth or t[2] < 2 * p.min_rows
                self.nodes.append(_Node(n.depth + 1, t, () if done else None))
            n.left, n.right = len(self.nodes) - 2, len(self.nodes) - 1

    def replay(self, p: H.Growth) -> tuple[list[int], list[int]]:
        """Best-first order on what is known: (split nodes, nodes to be judged). The
        order is final when nothing is left to judge."""
        if self.nodes[0].split is None:
            return [], [0]
        order, unknown, open_ = [], [], []
        if self.nodes[0].split:
            open_.append((self.nodes[0].split[0], 0))
        while open_ and len(order) + 1 < p.max_leaves:
            _, i = heapq.heappop(open_)
            order.append(i)
            self.children(i, p)
            for j in (self.nodes[i].left, self.nodes[i].right):
                if self.nodes[j].split is None:
                    unknown.append(j)
                elif self.nodes[j].split:
                    heapq.heappush(open_, (self.nodes[j].split[0], j))
        return order, unknown

    def graft(self, i: int, nodes: list) -> None:
        """Hang a subtree grown in a task below node i."""
        place = {0: i}
        for j, (left, right, gain, feature, absent_right, cut, g, h, n) in enumerate(nodes):
            node = self.nodes[place[j]]
            node.total = (g, h, n)
            if left < 0:
                node.split = ()
                continue
            lt = nodes[left][6:]
            node.split = (gain, feature, absent_right, cut, *lt)
            for child in (left, right):
                self.nodes.append(_Node(node.depth + 1))
                place[child] = len(self.nodes) - 1
            node.left, node.right = place[left], place[right]

    def tree(self, order: list[int], rate: float, l2: float) -> H.Tree:
        """The chosen splits as arrays, nodes renumbered from the root."""
        chosen, place, queue = set(order), {0: 0}, [0]
        for i in queue:
            if i in chosen:
                for j in (self.nodes[i].left, self.nodes[i].right):
                    place[j] = len(place)
                    queue.append(j)
        out = []
        for i in queue:
            n = self.nodes[i]
            if i in chosen:
                _, feature, absent_right, cut, *_ = n.split
                out.append((feature, cut, not absent_right, place[n.left], place[n.right], 0.0))
            else:
                g, h, _ = n.total or (0, 0, 0)
                below = h + l2 * H.SCALE
                out.append((-1, 0, True, -1, -1, -rate * g / below if below > 0 else 0.0))
        self.place = place
        return H.Tree.of(out)


def _spread(since, partial, wanted, outputs: int, curvature: float):
    """Task: apply the trees since the written margins, take gradients, route every
    row through the partial trees, and emit it for each wanted node it lies in.
    ``wanted``: for each output, node of the partial tree -> slot."""
    used = H.used_features([t for trees in since for t in trees] + partial)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (offsets, f), (_, b) = H.lists(batch.column("f")), H.lists(batch.column("b"))
            x = H.dense(offsets, f, b, used, -1, np.int32)
            m = H.add_trees(H.margins_of(batch.column("m"), outputs), x, used, since)
            g, h = H.gradients(m, batch.column("y").to_numpy(), batch.column("w").to_numpy(), curvature)
            for o in range(outputs):
                ids = wanted[o]
                if not ids:
                    continue
                slot = np.full(len(partial[o].left), -1, np.int32)
                slot[list(ids)] = list(ids.values())
                slot = slot[partial[o].leaf_of(x, used)]
                rows = np.flatnonzero(slot >= 0)
                if rows.size:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(slot[rows]), pa.array(g[rows, o]), pa.array(h[rows, o]), batch.column("f").take(at),
                                                      batch.column("b").take(at)], ["slot", "g", "h", "f", "b"])
    return work


_ROWS = "slot int, g long, h long, f array<int>, b array<int>"
_SUBTREE = ("slot int, lo array<int>, hi array<int>, gain array<double>, feature array<int>, absent_right array<boolean>, "
            "cut array<int>, tg array<long>, th array<long>, tn array<long>")


def _finish(p: H.Growth, depths: list[int]):
    """Task: grow the whole subtree of one node, whose rows are the partition."""
    def work(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            slot = table.column("slot")[0].as_py()
            (offsets, f), (_, b) = H.lists(table.column("f")), H.lists(table.column("b"))
            cols = zip(*H.grow(offsets, f, b, table.column("g").to_numpy(), table.column("h").to_numpy(), p, depths[slot]))
            types = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["lo", "hi", "gain", "feature", "absent_right", "cut", "tg", "th", "tn"]
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), *[pa.array([list(c)], pa.list_(t)) for c, t in zip(cols, types)]],
                                             ["slot", *names])
    return work


def level_splits(rows: DataFrame, totals: DataFrame, p: H.Growth) -> DataFrame:
    """Best split of every slot (a node of some output's tree) of ``rows`` by one
    aggregate over (slot, feature, bin); windows run over the at most 255 bins of a
    feature. ``totals(slot, tg, th, tn)`` has one row per node judged."""
    cells = (rows.select("slot", "g", "h", F.explode(F.arrays_zip("f", "b")).alias("c"))
             .groupBy("slot", F.col("c.f").alias("f"), F.col("c.b").alias("b"))
             .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")))
    by = Window.partitionBy("slot", "f")
    run, one = by.orderBy("b").rowsBetween(Window.unboundedPreceding, 0), by.orderBy("b")
    c = cells.select("*", *[F.sum(x).over(run).alias(f"run_{x}") for x in "ghn"], *[F.sum(x).over(by).alias(f"all_{x}") for x in "ghn"],
                     F.coalesce(F.lag("b").over(one), F.lit(-1)).alias("below"), F.lead("b").over(one).isNull().alias("last"))
    c = c.join(F.broadcast(totals), "slot")
    side = lambda absent, cut, sums, ok: F.struct(
        F.lit(absent).alias("absent_right"), cut.cast("int").alias("cut"), *[s.alias(f"l{x}") for x, s in zip("ghn", sums)], ok.alias("ok"))
    cuts = [side(False, F.col("below"), [F.col(t) - F.col(f"all_{x}") + F.col(f"run_{x}") - F.col(x) for x, t in zip("ghn", ("tg", "th", "tn"))], F.lit(True))]
    if p.learned_side:
        cuts.append(side(True, F.col("b"), [F.col(f"run_{x}") for x in "ghn"], ~F.col("last") & (F.col("all_n") < F.col("tn"))))
    c = c.select("slot", "f", "tg", "th", "tn", F.inline(F.array(*cuts)))
    l2, least = F.lit(p.l2 * H.SCALE), F.lit(p.min_hessian * H.SCALE)
    rh = F.col("th") - F.col("lh")
    c = c.where(F.col("ok") & (F.col("ln") >= p.min_rows) & (F.col("tn") - F.col("ln") >= p.min_rows) & (F.col("lh") >= least) & (rh >= least)
                & (F.col("lh") + l2 > 0) & (rh + l2 > 0))
    sq = lambda g, h: g.cast("double") * g.cast("double") / (h.cast("double") + l2)
    gain = sq(F.col("lg"), F.col("lh")) + sq(F.col("tg") - F.col("lg"), rh) - F.when(F.col("th") + l2 > 0, sq(F.col("tg"), F.col("th"))).otherwise(0.0)
    c = c.withColumn("gain", gain).where("gain > 0")
    best = F.min(F.struct((-F.col("gain")).alias("neg"), F.col("f"), F.col("absent_right"), F.col("cut"), "lg", "lh", "ln"))
    return c.groupBy("slot").agg(best.alias("s")).select("slot", "s.*")


class _Trainer:
    def __init__(self, rows: DataFrame, classes: int, params: Boosting, group_cells: int):
        self.spark, self.p, self.classes = rows.sparkSession, params, classes
        ship(self.spark)
        self.outputs = 1 if classes == 2 else classes
        self.group_cells = group_cells
        self.aside = SharedTables(self.spark, "boost")
        w = [F.coalesce(F.sum(F.when(F.col("y") == k, F.col("w"))), F.lit(0.0)).alias(f"w{k}") for k in range(classes)]
        rows = self.aside.write(rows, "rows")
        top = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("f")), F.lit(0)).alias("widest"),
                       F.coalesce(F.sum(F.size("f")), F.lit(0)).alias("cells"), *w).first()
        self.n, self.widest, self.cells = top["n"], max(top["widest"], 1), top["cells"]
        self.start = self._start([top[f"w{k}"] for k in range(classes)])
        self.curvature = params.curvature if params.curvature is not None else classes / max(classes - 1, 1)
        self.rows, self.state, self.held, self.since = rows, None, None, []
        self.hold(rows.withColumn("m", F.array(*map(F.lit, self.start))))

    def _start(self, w: list[float]) -> list[float]:
        if self.p.init == "zero":
            return [0.0] * self.outputs
        tiny, total = 1e-15, sum(w) or 1.0
        share = [max(x / total, tiny) for x in w]
        if self.outputs == 1:
            return [math.log(share[1] / share[0])]
        logs = [math.log(s) for s in share]
        mean = sum(logs) / len(logs)
        return [v - mean for v in logs]

    def hold(self, df: DataFrame) -> None:
        """Write the rows with their margins aside and keep them in memory."""
        new = self.aside.write(df, "state")
        cached = new.persist(StorageLevel.MEMORY_AND_DISK)
        cached.count()
        if self.state is not None:
            self.release()
        self.state, self.held, self.since = sized_partitions(cached, 8 << 20), cached, []

    def release(self) -> None:
        self.held.unpersist()
        self.aside.drop(self.held)

    def refresh(self) -> None:
        since, outputs = self.since, self.outputs
        used = H.used_features([t for trees in since for t in trees])

        def work(batches):
            for batch in batches:
                (offsets, f), (_, b) = H.lists(batch.column("f")), H.lists(batch.column("b"))
                m = H.add_trees(H.margins_of(batch.column("m"), outputs), H.dense(offsets, f, b, used, -1, np.int32), used, since)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * outputs, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in "ywfb"] + [lists], ["y", "w", "f", "b", "m"])

        self.hold(self.state.mapInArrow(work, "y int, w double, f array<int>, b array<int>, m array<double>"))

    def judge(self, trees: list[_Growing], partial: list[H.Tree], unknown: list[list[int]]) -> None:
        """Find the splits of all unknown nodes, in at most three jobs."""
        p = self.p.growth
        nodes = [(o, j) for o, ids in enumerate(unknown) for j in ids]
        at = lambda slot: trees[slot[0]].nodes[slot[1]]
        fits = lambda slot: min((at(slot).total or (0, 0, self.n))[2] * self.widest, self.cells) <= self.group_cells
        big, small = [s for s in nodes if not fits(s)], [s for s in nodes if fits(s)]

        def spread(slots):
            wanted: list[dict] = [{} for _ in trees]
            for i, (o, j) in enumerate(slots):
                wanted[o][trees[o].place[j]] = i
            return self.state.mapInArrow(_spread(self.since, partial, wanted, self.outputs, self.curvature), _ROWS)

        if big:
            rows = spread(big)
            if any(at(s).total is None for s in big):
                for r in rows.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n")).collect():
                    at(big[r["slot"]]).total = (r["g"], r["h"], r["n"])
            totals = self.spark.createDataFrame([(i, *at(s).total) for i, s in enumerate(big)], "slot int, tg long, th long, tn long")
            for r in level_splits(rows, totals, p).collect():  # one row per node
                at(big[r["slot"]]).split = tuple(r)[1:]
        if small:
            # One partition per node to be finished: the driver knows them all, so no two share a task.
            done = spread(small).repartitionById(len(small), F.col("slot")).mapInArrow(_finish(p, [at(s).depth for s in small]), _SUBTREE)
            for r in done.collect():  # one row per subtree
                o, j = small[r["slot"]]
                trees[o].graft(j, list(zip(*tuple(r)[1:])))
        for s in nodes:
            if at(s).split is None:
                at(s).split = ()

    def round(self) -> None:
        p = self.p.growth
        trees = [_Growing() for _ in range(self.outputs)]
        while True:
            found = [t.replay(p) for t in trees]
            partial = [t.tree(order, self.p.learning_rate, p.l2) for t, (order, _) in zip(trees, found)]
            if not any(unknown for _, unknown in found):
                break
            self.judge(trees, partial, [unknown for _, unknown in found])
        self.since.append(partial)

    def fit(self) -> list[list[H.Tree]]:
        rounds = []
        for r in range(self.p.rounds if self.n else 0):
            self.round()
            rounds.append(self.since[-1])
            if len(self.since) == REFRESH and r + 1 < self.p.rounds:
                self.refresh()
        self.release()
        self.aside.drop(self.rows)
        return rounds


def fit_boosted(long: DataFrame, labels: DataFrame, classes: int, params: Boosting, group_cells: int = GROUP_CELLS) -> BoostedTrees:
    """Fit on long-form features ``(id, idx, weight)`` and ``labels(id, label_idx, weight)``."""
    edges = feature_edges(long, min_rows=params.growth.min_rows).persist()
    trainer = _Trainer(binned_rows(long, labels, edges), classes, params, group_cells)
    trees = trainer.fit()
    # Cuts become feature values: edges of the features in use, bounded by the nodes.
    used = H.used_features([t for r in trees for t in r])
    wanted = long.sparkSession.createDataFrame([(int(f),) for f in used], "idx int")
    value = {r["idx"]: r["edges"] for r in edges.join(F.broadcast(wanted), "idx").collect()}
    edges.unpersist()

    def valued(t: H.Tree) -> H.Tree:
        cut = np.zeros(len(t.left))
        for i in np.flatnonzero(t.left >= 0):
            e = value[int(t.feature[i])]
            cut[i] = e[min(int(t.cut[i]), len(e) - 1)] if t.cut[i] >= 0 else -math.inf
        return replace(t, cut=cut)

    return BoostedTrees(classes, trainer.start, [[valued(t) for t in r] for r in trees], params.growth.learned_side)
