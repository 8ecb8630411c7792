"""Near-duplicate documents by min-max hashing.

One evaluation of a permutation over a document's shingle hashes gives two
signature values, the least and the greatest; each agrees between two sets with
probability equal to their Jaccard similarity, so ``2 P`` values cost ``P``
evaluations. Bands of ``ROWS`` values send similar sets to a common key with
probability ``1 - (1 - s^ROWS)^bands``; the number of bands is derived so that a
pair exactly at the threshold is missed with a probability of at most ``MISS``.

Work is linear until candidates are known:

1. one pass over the texts: set size, digest of the full set, band keys;
2. equal sets are one class, represented by the smallest id;
3. classes that share a band key with a hub (the smallest id of the key) are
   joined into candidate clusters by connected components - no pairs are made;
4. the sets of cluster members are recomputed from their whole texts and every
   cluster is compared in blocks of at most ``BLOCK_DOCS`` sets inside tasks,
   with exact intersections; a task emits a spanning forest of its links, never
   the links themselves;
5. connected components of those links, mapped back over the classes.

A cluster of several blocks is first compared with its first block (linear);
only members outside the largest group found that way are then compared with
all blocks, so a large group of close copies does not cost all its pairs.
"""
from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, slices

ROWS = 5            # signature values in a band
MISS = 1e-5         # chance to miss a pair exactly at the threshold
BLOCK_DOCS = 256    # sets compared at once; not a cap, larger clusters take more blocks
BLOCK_SHINGLES = 1 << 20
TEXT_CHUNK = 1 << 19
SEGMENT = 1 << 20
SEED = 20240917


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


class Shingler:
    """Hashes of the distinct ``k``-word shingles of texts, vectorised.

    Words are the runs of bytes other than 0x20 and 0x09-0x0D of the text with
    A-Z lower-cased. A word's hash is a polynomial over random byte values
    modulo 2^64, from differences of one prefix sum over the text.
    """

    def __init__(self, k: int):
        import numpy as np
        self.np, self.k = np, k
        rng = np.random.default_rng(SEED)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.byte = odd(256)
        self.base = int(odd(1)[0])
        self.inverse = pow(self.base, -1, 1 << 64)
        self.weight = odd(k)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self._powers(SEGMENT)

    def _powers(self, n: int) -> None:
        np = self.np
        for name, base in (("up", self.base), ("down", self.inverse)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def words(self, data: bytes):
        """``(hashes, starts)`` of the words of ``data`` (lower-cased bytes)."""
        np, hashes, starts = self.np, [], []
        at, raw = 0, np.frombuffer(data, np.uint8)
        while at < len(data):
            end = min(len(data), at + SEGMENT)
            if end < len(data):  # cut at white space; a longer word widens the segment
                spaces = np.flatnonzero(self.space[raw[at:end]])
                if len(spaces):
                    end = at + int(spaces[-1]) + 1
                else:
                    later = np.flatnonzero(self.space[raw[end:]])
                    end = end + int(later[0]) if len(later) else len(data)
            part = raw[at:end]
            if len(part) >= len(self.up):
                self._powers(len(part))
            inside = ~self.space[part]
            edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
            s, e = edge[::2], edge[1::2]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.byte[part] * self.up[:len(part)], out=total[1:])
            hashes.append(self.mix((total[e] - total[s]) * self.down[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
            at = end
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(hashes), np.concatenate(starts)

    def mix(self, x):
        np = self.np
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def sets(self, texts: list[str | None]) -> list:
        """Sorted distinct shingle hashes of each text."""
        np, raw, offsets, at = self.np, [], [0], 0
        for t in texts:
            b = (t or "").encode("utf-8", "replace").lower()
            raw.append(b)
            at += len(b) + 1
            offsets.append(at)
        hashes, starts = self.words(b" ".join(raw))
        cut = np.searchsorted(starts, offsets)
        n = len(hashes)
        if n >= self.k:
            full = np.zeros(n - self.k + 1, np.uint64)
            for j in range(self.k):
                full += hashes[j:n - self.k + 1 + j] * self.weight[j]
            full = self.mix(full + np.uint64(self.k))
        out = []
        for a, b in zip(cut, cut[1:], strict=False):
            m = int(b - a)
            if m >= self.k:
                out.append(np.unique(full[a:b - self.k + 1]))
            elif m:
                whole = (hashes[a:b] * self.weight[:m]).sum(dtype=np.uint64)
                out.append(self.mix(np.array([whole + np.uint64(m)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out

    def digest(self, s) -> bytes:
        return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class MinMax:
    """Band keys of shingle sets."""

    def __init__(self, percent: int, rows: int = ROWS):
        import numpy as np
        self.np, self.rows, self.bands = np, rows, band_count(percent, rows)
        n = math.ceil(self.bands * rows / 2)
        rng = np.random.default_rng(SEED + 1)
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def signatures(self, sets: list):
        """``2 P`` values of each non-empty set: least and greatest in turn."""
        np = self.np
        flat = np.concatenate(sets)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((len(sets), 2 * len(self.a)), np.uint64)
        for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            v = flat * a + b
            out[:, 2 * k] = np.minimum.reduceat(v, starts)
            out[:, 2 * k + 1] = np.maximum.reduceat(v, starts)
        return out

    def keys(self, sets: list, mix):
        """One 64-bit key for each band; the band's number is part of the key."""
        np = self.np
        sig = self.signatures(sets)[:, :self.bands * self.rows].reshape(len(sets), self.bands, self.rows)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), sig.shape[:2])
        for j in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j])
        return key.view(np.int64)


def _chunks(batch, size: int = TEXT_CHUNK):
    """Runs of a batch's rows with about ``size`` characters of text."""
    rows, chars = [], 0
    for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        rows.append(r)
        chars += len(r[1] or "")
        if chars >= size:
            yield rows
            rows, chars = [], 0
    if rows:
        yield rows


def signatures(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n_shingles, digest, keys)``; digest and keys are null for
    texts without words."""
    import pyarrow as pa

    def run(batches):
        shingler, minmax = Shingler(k), MinMax(percent)
        for batch in slices(batches, 2048):
            for rows in _chunks(batch):
                sets = shingler.sets([r[1] for r in rows])
                full = [s for s in sets if len(s)]
                keys = iter(minmax.keys(full, shingler.mix) if full else ())
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([shingler.digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "keys"])

    return (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>"))


def forest(sets: list, percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest ``(member, root)`` of the exact links between ``sets``;
    with ``left``, only links between the first ``left`` and the others count."""
    import numpy as np
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    inter = np.zeros((n, n), np.int64)
    if n <= 4:
        for i in range(n):
            for j in range(i + 1, n):
                inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1  # a shingle of one set cannot meet another
        number = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(n), size)
        keep = shared[word]
        word, owner = number[word[keep]], owner[keep]
        order = np.argsort(word, kind="stable")
        word, owner = word[order], owner[order]
        width = 1 << 13
        for at in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(word, (at, at + width))
            m = np.zeros((n, width), np.float32)
            m[owner[a:b], word[a:b] - at] = 1
            inter += (m @ m.T).astype(np.int64)
    link = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    if left is not None:
        link[:left, :left] = link[left:, left:] = False
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        new = np.where(link, label[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return [(i, int(r)) for i, r in enumerate(label) if i != r]


def _compare(members: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` of ``members(cluster, p, q, side, doc_id, s)``: rows of
    one ``(cluster, p, q)`` meet in a task; side 0 is block p, side 1 block q."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        key, ids, sets, left = None, [], [], 0

        def flush():
            two = left if key is not None and key[1] != key[2] else None
            return [(ids[i], ids[r]) for i, r in forest(sets, percent, two)] if len(ids) > 1 else []

        for batch in batches:
            out = []
            for c, p, q, side, doc_id, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, p, q) != key:
                    out += flush()
                    key, ids, sets, left = (c, p, q), [], [], 0
                ids.append(doc_id)
                sets.append(np.frombuffer(s, "<u8"))
                left += side == 0
            yield _pairs(pa, out)
        yield _pairs(pa, flush())

    return (members.select("cluster", "p", "q", "side", "doc_id", "s")
            .repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "side", "doc_id")
            .mapInArrow(run, "a bigint, b bigint"))


def _pairs(pa, out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                       pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def _member_sets(docs: DataFrame, members: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Sets of the members, from their whole texts."""
    import pyarrow as pa

    def run(batches):
        shingler = Shingler(k)
        for batch in slices(batches, 2048):
            for rows in _chunks(batch):
                got = [(r, s) for r, s in zip(rows, shingler.sets([r[1] for r in rows]), strict=True)
                       if len(s) and shingler.digest(s) == r[2]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r, _ in got], pa.int64()), pa.array([r[3] for r, _ in got], pa.int64()),
                    pa.array([r[4] for r, _ in got], pa.int32()), pa.array([r[5] for r, _ in got], pa.int32()),
                    pa.array([s.tobytes() for _, s in got], pa.binary())],
                    ["doc_id", "cluster", "blocks", "block", "s"])

    text = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return (text.join(members, "doc_id").select("doc_id", "text", "digest", "cluster", "blocks", "block")
            .mapInArrow(run, "doc_id bigint, cluster bigint, blocks int, block int, s binary"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Documents with ``100 |A & B| >= percent |A | B|`` over their sets of ``k``-word
    shingles are linked; components are the transitive closure. Null, empty and
    blank texts have size 0 and stand alone; a text with fewer than ``k`` words
    is one shingle; equal texts are always linked; repeated rows come back as
    often as they came; a row with a null id stands alone (null component,
    kept); an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    sig = scratch.write(signatures(docs, k, percent, id_col, text_col), "signatures")
    usable = sig.where("doc_id is not null and digest is not null")
    # Equal sets have equal keys, so any of the class's rows will do.
    classes = scratch.write(usable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    keyed = classes.select("rep", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = (keyed.join(hubs.select("key", "hub"), "key").where("rep <> hub")
            .select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    clusters = connected_components(near, scratch)
    links = _links(docs, classes, clusters, k, percent, id_col, text_col, scratch)
    groups = connected_components(links, scratch).withColumnRenamed("node", "rep")
    owner = (classes.select("digest", "rep").join(groups, "rep", "left")
             .select("digest", F.coalesce("component", "rep").alias("component_id")))
    out = sig.select("doc_id", "n_shingles", "digest").join(owner, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _links(docs, classes, clusters, k, percent, id_col, text_col, scratch) -> DataFrame:
    """Exact links inside candidate clusters, as forests."""
    members = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(
        classes.select(F.col("rep").alias("doc_id"), "digest", "n"), "doc_id")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = members.join(sizes.select("cluster", blocks.alias("blocks")), "cluster")
    members = members.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    sets = scratch.write(_member_sets(docs, members.drop("n"), k, id_col, text_col), "sets")

    zero = F.lit(0)
    small = sets.where("blocks = 1").withColumns({"p": zero, "q": zero, "side": zero})
    # Linear pass: block 0 with itself and with every other block.
    large = sets.where("blocks > 1")
    q = F.explode(F.when(F.col("block") == 0, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array("block")))
    first = (large.withColumns({"p": zero, "q": q}).withColumn("side", F.when(F.col("block") == 0, 0).otherwise(1)))
    links = scratch.write(_compare(small.unionByName(first), percent), "links")
    if large.isEmpty():
        return links

    # Members outside their cluster's largest group so far still meet all others.
    found = connected_components(links, scratch)
    state = (large.select("cluster", "blocks", "block", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
             .withColumn("group", F.coalesce("component", "doc_id")))
    counts = state.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("c"))
    major = counts.groupBy("cluster").agg(F.max(F.struct("c", "group")).alias("m")).select("cluster", F.col("m.group").alias("major"))
    rest = state.join(major, "cluster").withColumn("minor", F.col("group") != F.col("major"))
    minor_blocks = rest.where("minor").groupBy("cluster").agg(F.collect_set("block").alias("minors"))  # one int a block
    rest = scratch.write(rest.select("cluster", "doc_id", "minor").join(minor_blocks, "cluster"), "rest")
    again = large.join(rest.select("doc_id", "minor", "minors"), "doc_id")
    # Group (p, q): the minor rows of block p (side 0) against all rows of block q.
    meet = lambda p, q, side: F.struct(p.alias("p"), q.alias("q"), side.alias("side"))
    as_partner = F.transform("minors", lambda p: meet(p, F.col("block"), F.when(p == F.col("block"), 0).otherwise(1)))
    others = F.filter(F.sequence(zero, F.col("blocks") - 1), lambda q: q != F.col("block"))
    as_minor = F.transform(others, lambda q: meet(F.col("block"), q, zero))
    pairs = F.when(F.col("minor"), F.concat(as_partner, as_minor)).otherwise(as_partner)
    again = again.withColumn("x", F.explode(pairs)).select("cluster", "x.p", "x.q", "x.side", "doc_id", "s")
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return stars.unionByName(scratch.write(_compare(again, percent), "links"))
