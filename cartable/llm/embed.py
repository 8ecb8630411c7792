"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are rotated to principal axes, largest first. A rotation keeps dot
products, so the products of the leading axes plus the product of the suffix
norms bound the cosine from above; a pair is dropped as soon as that bound is
below the threshold, and the cosine of the pairs that are left is computed in
double precision from the given components.

Rows are dealt to tiles by median cuts along the leading axes. A tile pair whose
boxes are too far apart is never made; every other pair of tiles meets in one
task, which returns link counts and a spanning forest, not the links. The axes
and the cuts come from a bounded sample (they steer cost, never the result); all
rows are compared. Equal vectors are one class before anything is compared.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

TILE_ROWS = 4096
MAX_TILES = 4096          # bounds the table of boxes; beyond it tiles grow
SAMPLE_BYTES = 16 << 20   # of vectors that axes and cuts are fitted on
CUT_AXES = 8
BOX_AXES = 16
SUB = 1024
SLACK = 1e-5              # single-precision error of the bounds
DENSE = 0.02              # share of pairs left up to which pairs are gathered


def _unit(x):
    import numpy as np
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column, dim: int):
    """Arrow list column -> ``(rows, dim)`` doubles."""
    import numpy as np
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


class Tiles:
    """Axes, median cuts and tile numbers."""

    def __init__(self, sample, depth: int):
        import numpy as np
        u = _unit(sample)
        values, axes = np.linalg.eigh(u.T @ u)
        self.axes = axes[:, np.argsort(values)[::-1]]
        self.depth = depth
        p = u @ self.axes
        number, self.cuts = np.zeros(len(p), np.int64), []
        for level in range(depth):
            axis = level % min(CUT_AXES, p.shape[1])
            cut = np.zeros(1 << level)
            for node in range(1 << level):
                own = p[number == node, axis]
                cut[node] = np.median(own) if len(own) else 0.0
            self.cuts.append(cut)
            number = 2 * number + (p[:, axis] > cut[number])

    def project(self, x):
        return _unit(x) @ self.axes

    def number(self, p):
        import numpy as np
        out = np.zeros(len(p), np.int64)
        for level, cut in enumerate(self.cuts):
            out = 2 * out + (p[:, level % min(CUT_AXES, p.shape[1])] > cut[out])
        return out


def near_pairs(u1, p1, u2, p2, threshold: float):
    """Index pairs ``(i, j)`` with cosine >= threshold between two sets of unit
    vectors ``u`` with rotated coordinates ``p``."""
    import numpy as np
    d = p1.shape[1]
    steps = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), d})
    a, b = p1.astype(np.float32), p2.astype(np.float32)
    acc = np.zeros((len(a), len(b)), np.float32)
    at = 0
    for k in steps:
        acc += a[:, at:k] @ b[:, at:k].T
        at = k
        s1 = np.sqrt((p1[:, k:] ** 2).sum(1)).astype(np.float32)
        s2 = np.sqrt((p2[:, k:] ** 2).sum(1)).astype(np.float32)
        alive = acc + s1[:, None] * s2[None, :] >= threshold - SLACK
        left = int(alive.sum())
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left <= DENSE * alive.size:
            break
    i, j = np.nonzero(alive)
    keep = np.empty(len(i), bool)
    for c in range(0, len(i), 1 << 16):
        keep[c:c + (1 << 16)] = np.einsum("ij,ij->i", u1[i[c:c + (1 << 16)]], u2[j[c:c + (1 << 16)]]) >= threshold
    return i[keep], j[keep]


def _hook(label, i, j):
    """Union of the pairs into ``label`` (smallest index of each group)."""
    import numpy as np
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def compare(ids, counts, x, left: int | None, axes, threshold: float):
    """Links inside one tile (``left`` None) or between its first ``left`` rows
    and the others: ``(added links of each row, group label of each row)``."""
    import numpy as np
    n, u = len(ids), _unit(x)
    p = u @ axes
    added, label = np.zeros(n, np.int64), np.arange(n)
    one, two = (range(n), range(n)) if left is None else (range(left), range(left, n))
    for r in range(one.start, one.stop, SUB):
        r2 = min(r + SUB, one.stop)
        for c in range(two.start, two.stop, SUB):
            c2 = min(c + SUB, two.stop)
            if left is None and c < r:
                continue
            i, j = near_pairs(u[r:r2], p[r:r2], u[c:c2], p[c:c2], threshold)
            i, j = i + r, j + c
            if left is None and c == r:
                i, j = i[i < j], j[i < j]
            if len(i):
                np.add.at(added, i, counts[j])
                np.add.at(added, j, counts[i])
                label = _hook(label, i, j)
    return added, label


def _class_links(classes: DataFrame, dim: int, n: int, threshold: float, scratch: Scratch) -> DataFrame:
    """``(a, b, added)``: ``added`` links of class ``a``, or a forest edge ``(a, b)``."""
    import numpy as np
    import pyarrow as pa
    most = max(256, SAMPLE_BYTES // (8 * dim))
    sample = classes.orderBy(F.xxhash64("rep")).limit(most).select("embedding").collect()
    depth = max(0, min(int(math.log2(MAX_TILES)), math.ceil(math.log2(max(1, n / TILE_ROWS)))))
    tiles = Tiles(np.array([r[0] for r in sample], np.float64), depth)
    k = min(BOX_AXES, dim)

    def deal(batches):
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(2), dim)
                p = tiles.project(x)
                yield pa.RecordBatch.from_arrays([
                    pa.array(tiles.number(p), pa.int32()), batch.column(0), batch.column(1),
                    pa.array([v.tobytes() for v in x], pa.binary()),
                    pa.array(list(p[:, :k]), pa.list_(pa.float64()))], ["tile", "rep", "cnt", "v", "lead"])

    dealt = scratch.write(classes.select("rep", "cnt", "embedding").mapInArrow(
        deal, "tile int, rep bigint, cnt bigint, v binary, lead array<double>"), "dealt")
    # At most MAX_TILES boxes of 2 k numbers.
    box = dealt.groupBy("tile").agg(*[f("lead", i).alias(f"{name}{i}") for i in range(k)
                                      for name, f in (("lo", lambda c, i: F.min(F.col(c)[i])),
                                                      ("hi", lambda c, i: F.max(F.col(c)[i])))]).collect()
    names = np.array([r["tile"] for r in box])
    lo = np.array([[r[f"lo{i}"] for i in range(k)] for r in box])
    hi = np.array([[r[f"hi{i}"] for i in range(k)] for r in box])
    apart = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors at the threshold

    def partners(batches):
        for batch in batches:
            tile = batch.column(0).to_pylist()
            out = []
            for t in tile:
                at = int(np.flatnonzero(names == t)[0])
                gap = np.maximum(0, np.maximum(lo - hi[at], lo[at] - hi))
                out.append(names[(gap ** 2).sum(1) <= apart].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["tile", "with"])

    meets = scratch.write(dealt.select("tile").distinct().mapInArrow(partners, "tile int, with array<int>"), "meets")
    rows = (dealt.select("tile", "rep", "cnt", "v").join(meets, "tile").withColumn("w", F.explode("with"))
            .select(F.least("tile", "w").alias("p"), F.greatest("tile", "w").alias("q"),
                    (F.col("tile") > F.col("w")).cast("int").alias("side"), "rep", "cnt", "v"))

    def run(batches):
        key, held = None, []

        def flush():
            if key is None:
                return
            ids, cnt, side = (np.concatenate([h[i] for h in held]) for i in range(3))
            x = np.concatenate([h[3] for h in held])
            left = None if key[0] == key[1] else int((side == 0).sum())
            added, label = compare(ids, cnt, x, left, tiles.axes, threshold)
            a, e = np.flatnonzero(added), np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids[a], ids[e]]), pa.int64()),
                pa.array([None] * len(a) + ids[label[e]].tolist(), pa.int64()),
                pa.array(added[a].tolist() + [None] * len(e), pa.int64())], ["a", "b", "added"])

        for batch in batches:
            p, q, side, rep, cnt = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(p):
                continue
            x = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<f8").reshape(-1, dim)
            cut = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(q) != 0)) + 1).tolist(), len(p)]
            for s, e in zip(cut, cut[1:], strict=False):
                if (int(p[s]), int(q[s])) != key:
                    yield from flush()
                    key, held = (int(p[s]), int(q[s])), []
                held.append((rep[s:e], cnt[s:e], side[s:e], x[s:e]))
        yield from flush()

    return scratch.write(rows.repartition("p", "q").sortWithinPartitions("p", "q", "side", "rep")
                         .mapInArrow(run, "a bigint, b bigint, added bigint"), "links")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                           vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors are linked if their cosine in double precision is at least
    ``threshold``. Null or empty vectors, zero vectors and vectors with a null
    or non-finite component link with nothing; so do rows with a null id.
    Vectors of different lengths are never linked. Repeated rows count as
    vectors of their own and come back as often as they came. An empty table
    gives an empty result; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "embed")
    v = F.col("embedding")
    usable = (F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
              & F.exists(v, lambda x: x != 0))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding"))
    # Two seeds of a 64-bit hash name a class of equal vectors.
    rows = rows.withColumns({"ok": F.coalesce(usable, F.lit(False)), "h1": F.xxhash64("embedding"),
                             "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = scratch.write(rows.where("ok").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("cnt"), F.first("embedding").alias("embedding")), "classes")
    parts = [_class_links(classes.where(F.size("embedding") == r["dim"]), r["dim"], r["n"], threshold, scratch)
             for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()]
    info = classes.select("h1", "h2", "rep", "cnt")
    if parts:
        links = parts[0]
        for other in parts[1:]:
            links = links.unionByName(other)
        added = links.where("added is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("added").alias("added"))
        groups = connected_components(links.where("b is not null").select("a", "b"), scratch).withColumnRenamed("node", "rep")
        info = info.join(added, "rep", "left").join(groups, "rep", "left")
    else:
        info = info.withColumns({"added": F.lit(None).cast("bigint"), "component": F.lit(None).cast("bigint")})
    out = rows.select("vec_id", "ok", F.when(F.col("ok"), F.col("h1")).alias("h1"), F.when(F.col("ok"), F.col("h2")).alias("h2"))
    out = out.join(info, ["h1", "h2"], "left")
    return out.select(
        "vec_id", F.coalesce(F.col("cnt") - 1 + F.coalesce("added", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
