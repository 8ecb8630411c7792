"""Random forest without a depth limit (M04), grown in two phases.

Each tree takes its own bootstrap sample (a Poisson(1) count per row, from a hash
of row and tree) and each node its own features (a hash of node and feature, on
average ``max_features`` of them; if none of these splits the node, the next draw
is tried, until all are through). So a split depends on data and seed alone:

* a node of too many rows is split by one aggregate over (node, feature, bin) for
  all nodes of a batch of trees at once, over its drawn features only;
* a node whose rows fit ``GROUP_CELLS`` feature values is finished in one task, to
  any depth, with a stack; if whole trees fit, a task grows several from its rows.

Nodes of subtrees are as many as the rows deserve, so they stay in a written table;
the driver holds the upper levels only. Scoring ships the table to the tasks if it
is small by count (``BROADCAST_NODES``), otherwise rows go to their subtrees.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..session import SharedTables, ship
from . import histogram_trees as H
from .boosting import GROUP_CELLS, binned_rows, feature_edges
from .models import sized_partitions

ROWS_PER_BATCH = 200_000_000  # rows times trees that one batch of trees sends through a shuffle
BROADCAST_NODES = 2_000_000   # a forest of at most this many nodes is shipped to the tasks (40 bytes and the classes each)
WEIGHT = 1 << 16              # class weights are whole numbers of 1 / WEIGHT


@dataclass(frozen=True)
class Forest:
    trees: int = 100
    max_depth: int = 1 << 30
    max_features: float | str | None = "sqrt"  # "sqrt", a number, or None for all
    min_rows: int = 1
    seed: int = 42


def forest_params(params: dict) -> Forest:
    depth = params.get("max_depth")
    return Forest(int(params.get("n_estimators", 100)), int(depth) if depth else 1 << 30, params.get("max_features", "sqrt"),
                  int(params.get("min_samples_leaf", 1)), int(params.get("random_state") or 0))


# ------------------------------------------------------------ inside tasks
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of whole numbers (splitmix finaliser)."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


# Chances of at most 0, 1, 2, ... occurrences under Poisson(1).
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(12)])


def root_key(seed: int, tree: int) -> int:
    return int(mix(mix(np.uint64(seed)) + np.uint64(tree)))


def child_key(key: int, right: bool) -> int:
    return int(mix(np.uint64(key) ^ np.uint64(1 + right)))


def bootstrap(rows: np.ndarray, key: int) -> np.ndarray:
    return np.searchsorted(_POISSON, unit(mix(rows.astype(np.uint64) ^ np.uint64(key))), "right")


def draws(features: np.ndarray, key: int, scale: float) -> np.ndarray:
    """The draw each feature belongs to: 0 for about one in ``scale``."""
    return (unit(mix(features.astype(np.uint64) ^ mix(np.uint64(key)))) * scale).astype(np.int64)


def _purity(sums: list, total) -> np.ndarray:
    """Sum of squared class weights over the side's weight, classes in order."""
    out = 0.0
    for s in sums:
        out = out + s.astype(float) * s.astype(float)
    return out / total.astype(float)


def best_gini(cell_f, cell_b, sums: np.ndarray, counts: np.ndarray, total: np.ndarray, n: int, least: int):
    """Best (-purity, feature, cut) by Gini over cells sorted by (feature, bin).
    Absent is the lowest value; ties go to the lowest feature, then the lowest cut."""
    first = np.r_[True, cell_f[1:] != cell_f[:-1]]
    start, last = np.flatnonzero(first), np.flatnonzero(np.r_[first[1:], True])
    seg = np.cumsum(first) - 1

    def left(c, whole):
        run = np.cumsum(c)
        base = (run - c)[start]
        return whole - (run[last] - base)[seg] + run - c - base[seg]
    ln = left(counts, n)
    ls = [left(sums[:, k], total[k]) for k in range(len(total))]
    i = np.flatnonzero((ln >= least) & (n - ln >= least))
    if not len(i):
        return None
    ls = [x[i] for x in ls]
    rs = [t - x for t, x in zip(total, ls)]
    score = _purity(ls, sum(ls[1:], ls[0])) + _purity(rs, sum(rs[1:], rs[0]))
    j = int(np.argmax(score))
    k = i[j]
    return -float(score[j]), int(cell_f[k]), -1 if first[k] else int(cell_b[k - 1])


def grow(offsets, f, b, y, w, classes: int, key: int, depth: int, p: Forest, scale: float) -> list[list]:
    """The whole tree below a node: ``[left, right, feature, cut, class weights]``,
    left -1 for a leaf. A stack, so chains of any depth are fine.

    Entries are kept by row and by feature. A node reads either the entries of its
    rows or those of its drawn features, whichever are fewer."""
    n, length, width = len(y), np.diff(offsets), int(b.max()) + 1 if len(b) else 1
    names = np.flatnonzero(np.bincount(f)) if len(f) else np.zeros(0, np.int64)
    local = np.searchsorted(names, f) if len(names) and names[-1] >= 1 << 24 else _places(names)[f]
    sorted_ = H.order_by(local)
    by_row, by_bin = np.repeat(np.arange(n, dtype=np.int32), length)[sorted_], b[sorted_]
    start = np.searchsorted(local[sorted_], np.arange(len(names) + 1))
    each = np.diff(start)
    del sorted_

    def of_rows(rows, key):
        """(draw, its entries as feature, bin, row) of a node, by reading its rows."""
        lens = length[rows]
        at = _ranges(offsets[rows], lens)
        owner, feature = np.repeat(rows, lens), local[at]
        draw = draws(names, key, scale)[feature] if len(at) > len(names) else draws(names[feature], key, scale)
        one = draw.min() if len(draw) else None
        while one is not None:
            e = np.flatnonzero(draw == one)
            yield feature[e], b[at[e]], owner[e]
            later = draw[draw > one]
            one = later.min() if len(later) else None

    def of_features(rows, key):
        """The same by reading the drawn features."""
        inside = np.zeros(n, bool)
        inside[rows] = True
        draw = draws(names, key, scale)
        for one in np.unique(draw):
            j = np.flatnonzero(draw == one)
            at = _ranges(start[j], each[j])
            r = by_row[at]
            e = np.flatnonzero(inside[r])
            if len(e):
                yield np.repeat(j, each[j])[e], by_bin[at[e]], r[e]

    nodes: list[list] = [[-1, -1, -1, 0, None]]
    stack = [(0, np.arange(n), key, depth)]
    while stack:
        i, rows, key, d = stack.pop()
        total = np.bincount(y[rows], w[rows], classes).astype(np.int64)
        nodes[i][4] = total.tolist()
        if d >= p.max_depth or (total > 0).sum() < 2 or len(rows) < 2 * p.min_rows:
            continue
        split = None
        for feature, bin_, r in (of_rows if length[rows].sum() * scale < len(f) else of_features)(rows, key):
            cells, place = np.unique(feature * width + bin_, return_inverse=True)
            sums = np.bincount(place * classes + y[r], w[r], len(cells) * classes).astype(np.int64).reshape(-1, classes)
            split = best_gini(names[cells // width], cells % width, sums, np.bincount(place, minlength=len(cells)), total, len(rows), p.min_rows)
            if split is not None:
                break
        if split is None:
            continue
        _, name, cut = split
        go = np.ones(n, bool)
        j = np.searchsorted(names, name)
        go[by_row[start[j]:start[j + 1]]] = by_bin[start[j]:start[j + 1]] <= cut
        go = go[rows]
        nodes[i][:4] = [len(nodes), len(nodes) + 1, name, cut]
        nodes += [[-1, -1, -1, 0, None], [-1, -1, -1, 0, None]]
        stack += [(nodes[i][0], rows[go], child_key(key, False), d + 1), (nodes[i][1], rows[~go], child_key(key, True), d + 1)]
    return nodes


def _places(names: np.ndarray) -> np.ndarray:
    """Name -> its place among the sorted names."""
    out = np.zeros(int(names[-1]) + 1 if len(names) else 1, np.int64)
    out[names] = np.arange(len(names))
    return out


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


# ------------------------------------------------------------------ driver
@dataclass
class _Top:
    """Upper levels of a tree: ``[left, right, feature, cut, class weights, key, depth, rows]``."""
    nodes: list[list] = field(default_factory=list)

    def tree(self) -> H.Tree:
        return H.Tree.of([(n[2], n[3], True, n[0], n[1], 0.0) for n in self.nodes])


_ROWS = "slot int, y int, w long, f array<int>, b array<int>"
_TABLE = "slot int, node int, `left` int, `right` int, feature int, cut int, weights array<long>"


def _spread(trees: dict, wanted: dict, drawn: dict | None, scale: float):
    """Task: bootstrap every row for every tree, route it through the upper levels,
    and emit it for the slot it lies in; with ``drawn`` (slot -> node key, draw) only
    the features of that draw."""
    used = H.used_features(list(trees.values()))

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (offsets, f), (_, b) = H.lists(batch.column("f")), H.lists(batch.column("b"))
            key, y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "y", "w"))
            x, length = H.dense(offsets, f, b, used, -1, np.int32), np.diff(offsets)
            for t, (root, places) in wanted.items():
                count = bootstrap(key, root)
                slot = np.full(len(trees[t].left), -1, np.int32)
                slot[list(places)] = list(places.values())
                slot = np.where(count > 0, slot[trees[t].leaf_of(x, used)], -1)
                for s in np.unique(slot[slot >= 0]):
                    rows = np.flatnonzero(slot == s)
                    at = pa.array(rows)
                    if drawn is None:
                        fs, bs = batch.column("f").take(at), batch.column("b").take(at)
                    else:
                        node, draw = drawn[int(s)]
                        mine = np.repeat(slot == s, length) & (draws(f, node, scale) == draw)
                        each = np.bincount(np.repeat(np.arange(len(key)), length)[mine], minlength=len(key))[rows]
                        ends = pa.array(np.r_[0, np.cumsum(each)].astype(np.int32))
                        fs, bs = (pa.ListArray.from_arrays(ends, pa.array(v[mine].astype(np.int32))) for v in (f, b))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows.size, s, np.int32)), pa.array(y[rows].astype(np.int32)), pa.array(w[rows] * count[rows]), fs, bs],
                        ["slot", "y", "w", "f", "b"])
    return work


def _finish(info: list, classes: int, p: Forest, scale: float):
    """Task: grow the subtree of each slot; a partition holds one slot's rows."""
    def work(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        slot = table.column("slot")[0].as_py()
        (offsets, f), (_, b) = H.lists(table.column("f")), H.lists(table.column("b"))
        y, w = table.column("y").to_numpy(), table.column("w").to_numpy()
        nodes = grow(offsets, f, b, y, w, classes, info[slot][0], info[slot][1], p, scale)
        yield from _batches(slot, nodes)
    return work


def _finish_trees(bundles: list, classes: int, p: Forest, scale: float):
    """Task: grow whole trees, each from its own sample of the partition's rows, which
    are all rows. ``bundles``: for each partition its (slot, root key) pairs."""
    def work(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        (offsets, f), (_, b) = H.lists(table.column("f")), H.lists(table.column("b"))
        key, y, w = (table.column(c).to_numpy() for c in ("key", "y", "w"))
        for slot, root in bundles[table.column("slot")[0].as_py()]:
            count = bootstrap(key, root)
            rows = np.flatnonzero(count)
            lens = np.diff(offsets)[rows]
            at = _ranges(offsets[rows], lens)
            nodes = grow(np.r_[0, np.cumsum(lens)], f[at], b[at], y[rows], w[rows] * count[rows], classes, root, 0, p, scale)
            yield from _batches(slot, nodes)
    return work


def _batches(slot: int, nodes: list):
    for i in range(0, len(nodes), 20_000):
        part = nodes[i:i + 20_000]
        left, right, feature, cut, weights = zip(*part)
        yield pa.RecordBatch.from_arrays(
            [pa.array([slot] * len(part), pa.int32()), pa.array(range(i, i + len(part)), pa.int32()),
             *[pa.array(c, pa.int32()) for c in (left, right, feature, cut)], pa.array(weights, pa.list_(pa.int64()))],
            ["slot", "node", "left", "right", "feature", "cut", "weights"])


def level_splits(rows: DataFrame, totals: DataFrame, classes: int, least: int) -> DataFrame:
    """Best Gini split of every slot by one aggregate over (slot, feature, bin);
    windows run over the at most 255 bins of a feature. ``totals(slot, tn, t0..)``."""
    ks = [f"k{k}" for k in range(classes)]
    cells = (rows.select("slot", "y", "w", F.explode(F.arrays_zip("f", "b")).alias("c")).groupBy("slot", F.col("c.f").alias("f"), F.col("c.b").alias("b"))
             .agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.when(F.col("y") == k, F.col("w"))), F.lit(0)).alias(c) for k, c in enumerate(ks)]))
    by = Window.partitionBy("slot", "f")
    run = by.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.select("slot", "f", F.coalesce(F.lag("b").over(by.orderBy("b")), F.lit(-1)).alias("cut"),
                     *[(F.sum(x).over(run) - F.col(x) - F.sum(x).over(by)).alias(x) for x in ["n", *ks]]).join(F.broadcast(totals), "slot")
    left = [F.col(x) + F.col(f"t{x[1:]}" if x != "n" else "tn") for x in ["n", *ks]]
    c = c.select("slot", "f", "cut", "tn", *[f"t{k}" for k in range(classes)], *[v.alias(x) for x, v in zip(["n", *ks], left)])
    c = c.where((F.col("n") >= least) & (F.col("tn") - F.col("n") >= least))

    def purity(sides: list[Column]) -> Column:
        sq = [s.cast("double") * s.cast("double") for s in sides]
        return sum(sq[1:], F.lit(0.0) + sq[0]) / sum(sides[1:], sides[0]).cast("double")
    score = purity([F.col(x) for x in ks]) + purity([F.col(f"t{k}") - F.col(x) for k, x in enumerate(ks)])
    best = F.min(F.struct((-score).alias("neg"), "f", "cut", "n"))
    return c.groupBy("slot").agg(best.alias("s")).select("slot", "s.*")


class RandomForest:
    """Top levels on the driver, subtrees in a written table. ``tops[t]`` has leaves
    that are final (class weights) or name a slot."""

    def __init__(self, classes: int, tops: list[list], subtrees: DataFrame, size: int, aside: SharedTables | None = None):
        self.classes, self.tops, self.subtrees, self.size, self.aside = classes, tops, subtrees, size, aside

    def release(self) -> None:
        if self.aside is not None:
            self.aside.drop(self.subtrees)

    def save(self, path: str) -> None:
        spark = self.subtrees.sparkSession
        self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        rows = [(t, i, n["left"], n["right"], n["feature"], n["cut"], n["weights"], n["slot"], self.classes)
                for t, top in enumerate(self.tops) for i, n in enumerate(top)]
        spark.createDataFrame(rows, "tree int, node int, `left` int, `right` int, feature int, cut double, weights array<long>, slot int, "
                                    "classes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/tops")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RandomForest":
        tops: dict = {}
        rows = sorted(spark.read.parquet(f"{path}/tops").collect(), key=lambda r: (r["tree"], r["node"]))  # the upper levels
        for r in rows:
            tops.setdefault(r["tree"], []).append({k: r[k] for k in ("left", "right", "feature", "cut", "weights", "slot")})
        subtrees = spark.read.parquet(f"{path}/subtrees")
        return RandomForest(rows[0]["classes"], [tops[t] for t in sorted(tops)], subtrees, subtrees.count())

    def predict(self, rows: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
        """``(id, proba)`` of rows ``(id, f, v)``: mean class shares of the leaves."""
        ship(rows.sparkSession)
        k, tops = self.classes, self.tops
        top_trees = [H.Tree.of([(n["feature"], n["cut"], True, n["left"], n["right"], float(n["slot"])) for n in t]) for t in tops]
        shares = [np.array([_share(n["weights"] or [0] * k) for n in t]) for t in tops]
        used = H.used_features(top_trees)
        if self.size <= broadcast_nodes:
            parts: dict = {}
            for r in self.subtrees.orderBy("slot", "node").collect():  # at most broadcast_nodes rows
                parts.setdefault(r["slot"], []).append(r)
            below = {s: _subtree(r) for s, r in parts.items()}
            every = H.used_features(top_trees + [t for t, _ in below.values()])

            def work(batches):
                for batch in batches:
                    (offsets, f), (_, v) = H.lists(batch.column("f")), H.lists(batch.column("v"))
                    for i in range(0, batch.num_rows, 512):
                        o = offsets[i:i + 513]
                        x = H.dense(o - o[0], f[o[0]:o[-1]], v[o[0]:o[-1]], every, np.nan, float)
                        p = np.zeros((len(x), k))
                        for tree, share in zip(top_trees, shares):
                            leaf = tree.leaf_of(x, every)
                            slots = tree.value[leaf].astype(int)
                            p += np.where((slots < 0)[:, None], share[leaf], 0.0)
                            for s in np.unique(slots[slots >= 0]):
                                at = np.flatnonzero(slots == s)
                                sub, sub_share = below[s]
                                p[at] += sub_share[sub.leaf_of(x[at], every)]
                        yield _scores(batch.column("id").slice(i, len(x)), p / len(tops))

            id_type = rows.schema["id"].dataType.simpleString()
            return rows.mapInArrow(work, f"id {id_type}, proba array<double>")

        def route(batches):  # (id, slot, f, v) for every tree; finished leaves carry their shares
            for batch in batches:
                (offsets, f), (_, v) = H.lists(batch.column("f")), H.lists(batch.column("v"))
                x = H.dense(offsets, f, v, used, np.nan, float)
                for tree, share in zip(top_trees, shares):
                    leaf = tree.leaf_of(x, used)
                    slots = tree.value[leaf].astype(np.int32)
                    done = pa.array([None if s >= 0 else p for s, p in zip(slots.tolist(), share[leaf].tolist())], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(slots), batch.column("f"), batch.column("v"), done],
                                                     ["id", "slot", "f", "v", "p"])

        def meet(rows_of, nodes_of):
            batches, out = [b for b in rows_of if b.num_rows], []
            nodes = pa.Table.from_batches(list(nodes_of)).sort_by("node").to_pylist()
            tree, share = _subtree(nodes)
            mine = H.used_features([tree])
            for b in batches:
                (offsets, f), (_, v) = H.lists(b.column("f")), H.lists(b.column("v"))
                out.append(_scores(b.column("id"), share[tree.leaf_of(H.dense(offsets, f, v, mine, np.nan, float), mine)]))
            return pa.Table.from_batches(out) if out else None

        id_type = rows.schema["id"].dataType.simpleString()
        routed = rows.mapInArrow(route, f"id {id_type}, slot int, f array<int>, v array<double>, p array<double>")
        at = routed.where("slot >= 0").groupBy("slot")
        def both(left, right):  # noqa: E306
            got = meet(left.to_batches(), right.to_batches())
            return got if got is not None else pa.table({"id": left.column("id").slice(0, 0), "proba": pa.array([], pa.list_(pa.float64()))})
        reached = at.cogroup(self.subtrees.groupBy("slot")).applyInArrow(both, f"id {id_type}, proba array<double>")
        parts = reached.unionByName(routed.where("slot < 0").select("id", F.col("p").alias("proba")))
        sums = [F.sum(F.col("proba")[c]) / len(tops) for c in range(k)]
        return parts.groupBy("id").agg(F.array(*sums).alias("proba"))


def _share(weights) -> list[float]:
    total = float(sum(weights)) or 1.0
    return [float(w) / total for w in weights]


def _subtree(rows) -> tuple[H.Tree, np.ndarray]:
    return (H.Tree.of([(r["feature"], r["cut"], True, r["left"], r["right"], 0.0) for r in rows]),
            np.array([_share(r["weights"]) for r in rows]))


def _scores(ids, p: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(np.ascontiguousarray(p).ravel()))
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    return pa.RecordBatch.from_arrays([ids, lists], ["id", "proba"])


def fit_forest(long: DataFrame, labels: DataFrame, classes: int, features: int, p: Forest, group_cells: int = GROUP_CELLS,
               rows_per_batch: int = ROWS_PER_BATCH) -> RandomForest:
    """Fit on long-form features ``(id, idx, weight)`` and ``labels(id, label_idx, weight)``."""
    spark = long.sparkSession
    ship(spark)
    aside = SharedTables(spark, "forest")
    m = {"sqrt": max(1.0, int(features ** 0.5)), None: float(features)}.get(p.max_features, p.max_features)
    scale = max(1.0, features / float(m))
    edges = feature_edges(long, min_rows=1).persist()
    whole = F.round(F.col("w") * WEIGHT).cast("long")
    binned = binned_rows(long, labels, edges, keep=[F.xxhash64("id").alias("key")]).withColumn("w", whole)
    written = aside.write(binned.where("w > 0"), "rows").persist(StorageLevel.MEMORY_AND_DISK)
    top = written.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("f")), F.lit(0)).alias("widest"),
                      F.coalesce(F.sum(F.size("f")), F.lit(0)).alias("cells")).first()
    n, widest, every = top["n"], max(top["widest"], 1), top["cells"]
    state = sized_partitions(written, 8 << 20)
    tops, tables, base, per = [], [], 0, max(1, rows_per_batch // max(n, 1))
    for lo in range(0, p.trees, per):
        batch = {t: _Top([[-1, -1, -1, 0, None, root_key(p.seed, t), 0, n]]) for t in range(lo, min(p.trees, lo + per))}
        big = lambda node: min(node[7] * widest, every) > group_cells
        open_ = [(t, 0, 0) for t in batch if big(batch[t].nodes[0])]  # (tree, node, draw)
        while open_:
            open_ = _level(spark, state, batch, open_, big, classes, p, scale)
        # Leaves of the upper levels that may go on become slots, one task each.
        slots = [(t, i) for t, top_ in batch.items() for i, node in enumerate(top_.nodes) if node[0] < 0 and node[4] is None]
        trees = {t: top_.tree() for t, top_ in batch.items()}
        wanted: dict = {t: (batch[t].nodes[0][5], {}) for t in {t for t, _ in slots}}
        for s, (t, i) in enumerate(slots):
            wanted[t][1][i] = s
        info = [(batch[t].nodes[i][5], batch[t].nodes[i][6]) for t, i in slots]
        if slots:
            if all(i == 0 for _, i in slots):  # whole trees: their rows are sent once for all trees of a task, not once for each
                count = min(len(slots), 2 * spark.sparkContext.defaultParallelism)
                bundles = [[(s, info[s][0]) for s in range(k, len(slots), count)] for k in range(count)]
                done = (state.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("slot"), "key", "y", "w", "f", "b")
                        .repartitionById(count, F.col("slot")).mapInArrow(_finish_trees(bundles, classes, p, scale), _TABLE))
            else:
                done = (state.mapInArrow(_spread(trees, wanted, None, scale), _ROWS).repartitionById(len(slots), F.col("slot"))
                        .mapInArrow(_finish(info, classes, p, scale), _TABLE))
            # Cuts become feature values: a join with the edges on the feature.
            cut = F.when(F.col("feature") < 0, 0.0).when(F.col("cut") < 0, F.lit(float("-inf"))).otherwise(F.get("edges", F.col("cut")))
            tables.append(aside.write(
                done.join(edges.withColumnRenamed("idx", "feature"), "feature", "left")
                .select((F.col("slot") + base).alias("slot"), "node", "left", "right", "feature", cut.alias("cut"), "weights"), "subtrees"))
        place = {ti: s + base for s, ti in enumerate(slots)}
        tops += [[{"left": x[0], "right": x[1], "feature": x[2], "cut": x[3], "weights": x[4], "slot": place.get((t, i), -1)}
                  for i, x in enumerate(top_.nodes)] for t, top_ in batch.items()]
        base += len(slots)
    _value_cuts(spark, edges, tops)
    subtrees = tables[0] if len(tables) == 1 else None
    if subtrees is None:
        merged = tables[0] if tables else spark.createDataFrame([], _TABLE.replace("cut int", "cut double"))
        for t in tables[1:]:
            merged = merged.unionByName(t)
        subtrees = aside.write(merged, "subtrees")
    written.unpersist()
    edges.unpersist()
    return RandomForest(classes, tops, subtrees, subtrees.count(), aside)


def _value_cuts(spark: SparkSession, edges: DataFrame, tops: list[list[dict]]) -> None:
    inner = [n for t in tops for n in t if n["left"] >= 0]
    if inner:
        wanted = spark.createDataFrame([(f,) for f in {n["feature"] for n in inner}], "idx int")
        value = {r["idx"]: r["edges"] for r in edges.join(F.broadcast(wanted), "idx").collect()}  # features of the upper levels
        for node in inner:
            node["cut"] = float(value[node["feature"]][node["cut"]]) if node["cut"] >= 0 else float("-inf")
    for t in tops:
        for node in t:
            node["cut"] = float(node["cut"])


def _level(spark, state: DataFrame, batch: dict, open_: list, big, classes: int, p: Forest, scale: float) -> list:
    """Split the open nodes by aggregates; returns the nodes to look at next."""
    trees = {t: top.tree() for t, top in batch.items()}
    wanted: dict = {t: (batch[t].nodes[0][5], {}) for t, _, _ in open_}
    for s, (t, i, _) in enumerate(open_):
        wanted[t][1][i] = s
    drawn = {s: (batch[t].nodes[i][5], d) for s, (t, i, d) in enumerate(open_)}
    rows = state.mapInArrow(_spread(trees, wanted, drawn, scale), _ROWS)
    sums = [F.coalesce(F.sum(F.when(F.col("y") == k, F.col("w"))), F.lit(0)).alias(f"t{k}") for k in range(classes)]
    totals = {r["slot"]: tuple(r)[1:] for r in rows.groupBy("slot").agg(F.count(F.lit(1)).alias("tn"), *sums).collect()}  # one row per node
    going, nxt = [], []
    for s, (t, i, d) in enumerate(open_):
        node, total = batch[t].nodes[i], totals.get(s, (0,) * (classes + 1))
        node[7] = total[0]
        if node[6] >= p.max_depth or sum(x > 0 for x in total[1:]) < 2 or total[0] < 2 * p.min_rows:
            node[4] = list(total[1:])
        elif big(node):
            going.append((s, *total))
        # otherwise its bootstrap sample fits a task
    if going:
        frame = spark.createDataFrame(going, "slot int, tn long, " + ", ".join(f"t{k} long" for k in range(classes)))
        split = {r["slot"]: r for r in level_splits(rows.join(F.broadcast(frame.select("slot")), "slot", "left_semi"), frame, classes, p.min_rows).collect()}
        for s, *total in going:
            t, i, d = open_[s]
            nodes = batch[t].nodes
            if s not in split:
                if d + 1 < scale:
                    nxt.append((t, i, d + 1))
                else:
                    nodes[i][4] = total[1:]
                continue
            r = split[s]
            for right in (False, True):
                count = r["n"] if not right else total[0] - r["n"]
                nodes.append([-1, -1, -1, 0, None, child_key(nodes[i][5], right), nodes[i][6] + 1, count])
                if big(nodes[-1]):
                    nxt.append((t, len(nodes) - 1, 0))
            nodes[i][:4] = [len(nodes) - 2, len(nodes) - 1, r["f"], r["cut"]]
    return nxt
