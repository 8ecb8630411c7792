"""Tree steps that run inside tasks, on the rows of one Arrow batch or one group.

Rows are sparse: a list of features and, beside it, the bin of each value.
Absent features are bin -1. Gradients are whole numbers (``SCALE`` units), so sums
do not depend on the order in which rows arrive, and a split found by Spark
aggregates equals one found here to the last bit.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SCALE = 1 << 26
CHUNK = 1 << 17  # entries whose sums are judged at a time


@dataclass(frozen=True)
class Growth:
    """What bounds a tree and how a split is judged."""
    max_depth: int = 6
    max_leaves: int = 1 << 30
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    learned_side: bool = False  # absent values choose their side; otherwise they are the lowest value


@dataclass
class Tree:
    """Nodes as arrays; a leaf has ``left`` -1. Left takes bins up to ``cut``."""
    feature: np.ndarray
    cut: np.ndarray
    absent_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(nodes: list[tuple]) -> "Tree":
        f, c, a, lo, hi, v = zip(*nodes)
        return Tree(np.array(f, np.int64), np.array(c), np.array(a, bool), np.array(lo, np.int64), np.array(hi, np.int64), np.array(v, float))

    def leaf_of(self, x: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Leaf of every row; ``x`` holds the values of the ``used`` features, below 0 or NaN if absent."""
        at = np.zeros(len(x), np.int64)
        column = np.searchsorted(used, self.feature)
        rows = np.arange(len(x))
        while rows.size:
            rows = rows[self.left[at[rows]] >= 0]
            node = at[rows]
            v = x[rows, column[node]]
            go = np.where((v >= 0), v <= self.cut[node], self.absent_left[node])
            at[rows] = np.where(go, self.left[node], self.right[node])
        return at


def used_features(trees: list[Tree]) -> np.ndarray:
    inner = [t.feature[t.left >= 0] for t in trees]
    return np.unique(np.concatenate(inner)) if inner else np.array([], np.int64)


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of an Arrow column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def dense(offsets, features, values, used: np.ndarray, absent, dtype) -> np.ndarray:
    """The ``used`` features of every row as a small matrix."""
    n = len(offsets) - 1
    x = np.full((n, max(len(used), 1)), absent, dtype)
    if len(used) and len(features):
        column = np.minimum(np.searchsorted(used, features), len(used) - 1)
        hit = used[column] == features
        x[np.repeat(np.arange(n), np.diff(offsets))[hit], column[hit]] = values[hit]
    return x


def probabilities(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-margins[:, 0]))
        return np.stack([1.0 - p, p], 1)
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray, w: np.ndarray, curvature: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole-numbered gradients and Hessians of the log loss, (rows, outputs)."""
    p = probabilities(margins)
    if margins.shape[1] == 1:
        p, target, curvature = p[:, 1:], (y == 1)[:, None], 1.0
    else:
        target = y[:, None] == np.arange(p.shape[1])
    g, h = (p - target) * w[:, None], curvature * p * (1.0 - p) * w[:, None]
    return np.rint(g * SCALE).astype(np.int64), np.rint(h * SCALE).astype(np.int64)


def _gain(g, h, l2):
    return g * g / (h + l2)


def best_split(cell_f, cell_b, cg, ch, cn, total, p: Growth):
    """Best split of a node from its (feature, bin) sums, or None.

    Cells are sorted by (feature, bin). Absent rows of a feature are the node's rows
    without its cells. A cut before a cell sends absent rows left; with
    ``learned_side`` a cut behind a cell sends them right. Of equal gains the
    lowest feature wins, then absent left, then the lowest cut."""
    G, H, N = total
    if not len(cn) or N < 2 * p.min_rows:
        return None
    first = np.r_[True, cell_f[1:] != cell_f[:-1]]
    last = np.r_[first[1:], True]
    seg = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    sums = []
    for c in (cg, ch, cn):
        run = np.cumsum(c)
        base = (run - c)[start]
        whole = run[last] - base
        sums.append((run - c - base[seg], whole[seg]))  # before the cell, whole feature
    (bg, wg), (bh, wh), (bn, wn) = sums
    l2, least = p.l2 * SCALE, p.min_hessian * SCALE
    parent = _gain(float(G), float(H), l2) if H + l2 > 0 else 0.0
    best = None
    sides = [(True, G - wg + bg, H - wh + bh, N - wn + bn, np.ones(len(cn), bool))]
    if p.learned_side:
        sides.append((False, bg + cg, bh + ch, bn + cn, ~last & (wn < N)))
    for absent_left, lg, lh, ln, ok in sides:
        ok = ok & (ln >= p.min_rows) & (N - ln >= p.min_rows) & (lh >= least) & (H - lh >= least) & (lh + l2 > 0) & (H - lh + l2 > 0)
        i = np.flatnonzero(ok)
        if not len(i):
            continue
        lgf, lhf, rgf, rhf = (a[i].astype(float) for a in (lg, lh, G - lg, H - lh))
        gain = _gain(lgf, lhf, l2) + _gain(rgf, rhf, l2) - parent
        j = int(np.argmax(gain))
        k = i[j]
        if gain[j] <= 0:
            continue
        cut = int(cell_b[k]) if not absent_left else -1 if first[k] else int(cell_b[k - 1])
        found = (-float(gain[j]), int(cell_f[k]), not absent_left, cut, int(lg[k]), int(lh[k]), int(ln[k]))
        best = found if best is None else min(best, found)
    return best


def order_by(*keys: np.ndarray) -> np.ndarray:
    """Places of entries in the order of whole-numbered keys from 0 on, the first one
    leading. Stable sorts of 16-bit keys are radix sorts."""
    order = None
    for key in reversed(keys):
        key = key if order is None else key[order]
        one = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
        order = one if order is None else order[one]
    return order


def grow(offsets, f, b, g, h, p: Growth, depth: int) -> list[tuple]:
    """Best-first growth of the tree below a node that holds all given rows.

    Returns nodes ``(left, right, -gain, feature, absent right, cut, G, H, N)``
    (left -1: not split). The entries are sorted by (feature, bin) once; a split
    deals them to its children in that order, so a node costs its own entries and
    the open leaves hold no more entries than the root."""
    n = len(g)
    width = int(b.max()) + 1 if len(b) else 1
    sorted_ = order_by(f, b)
    row = np.repeat(np.arange(n), np.diff(offsets))[sorted_]
    kind = np.int32 if len(f) and (int(f.max()) + 1) * width < 1 << 31 else np.int64
    cell = (f.astype(kind) * kind(width) + b.astype(kind))[sorted_]
    del sorted_

    def judge(cell, row, total):
        best, at = None, 0
        while at < len(cell):  # some features at a time, so that the sums stay small
            end = min(at + CHUNK, len(cell)) - 1
            end = int(np.searchsorted(cell, kind((int(cell[end]) // width + 1) * width)))
            c, r = cell[at:end], row[at:end]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            sums = *(np.add.reduceat(v.take(r), first) for v in (g, h)), np.diff(np.r_[first, len(c)])
            found = best_split(c[first] // width, c[first] % width, *sums, total, p)
            if found is not None and (best is None or found < best):
                best = found
            at = end
        return best

    nodes, open_, leaves = [], [], 1

    def able(total, d):
        return d < p.max_depth and total[2] >= 2 * p.min_rows and leaves < p.max_leaves

    def add(entries, total, d):
        split = judge(*entries, total) if entries is not None else None
        nodes.append([-1, -1, split, total])
        if split is not None:
            heapq.heappush(open_, (split[0], len(nodes) - 1, entries, d))
        return len(nodes) - 1

    total = (int(g.sum()), int(h.sum()), n)
    add((cell, row) if able(total, depth) else None, total, depth)
    del cell, row
    while open_ and leaves < p.max_leaves:
        _, i, (cell, row), d = heapq.heappop(open_)
        split, (G, H, N) = nodes[i][2], nodes[i][3]
        _, feature, absent_right, cut, *lt = split
        lt = tuple(lt)
        rt = (G - lt[0], H - lt[1], N - lt[2])
        leaves += 1
        lo, hi = np.searchsorted(cell, np.array([feature * width, (feature + 1) * width], kind))
        go = np.full(n, not absent_right)
        go[row[lo:hi]] = cell[lo:hi] <= feature * width + cut
        go = go[row] if able(lt, d + 1) or able(rt, d + 1) else None
        left = (cell[go], row[go]) if able(lt, d + 1) else None
        right = (cell[~go], row[~go]) if able(rt, d + 1) else None
        del cell, row, go
        nodes[i][0] = add(left, lt, d + 1)
        nodes[i][1] = add(right, rt, d + 1)
    return [(lo, hi, *(s[:4] if s is not None and lo >= 0 else (0.0, -1, False, 0)), *t) for lo, hi, s, t in nodes]


def margins_of(column, outputs: int) -> np.ndarray:
    return lists(column)[1].reshape(-1, outputs)


def add_trees(margins: np.ndarray, x: np.ndarray, used: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    """Margins after further rounds, in their order."""
    out = margins.copy()
    for trees in rounds:
        for o, t in enumerate(trees):
            out[:, o] += t.value[t.leaf_of(x, used)]
    return out
