"""Prefix trie of conversations: ternary search trees per range shard.

Turns (role and text) get dictionary ids, a conversation is its sequence of ids,
and conversations are range-partitioned in the order of (sequence, id). A shard is a
run of that order: its distinct sequences enter a ternary search tree, the middle
one first, then the middles of both halves, and so on, which keeps the search
trees among siblings balanced; members, leaves and savings are then added up from
the last node to the first, without recursion. Only nodes on the paths of a shard's
first and last sequence can go on in another shard. Those boundary nodes are
written as partial sums and merged by the digest of their prefix; each pair of
neighbouring shards adds the correction for what both counted (the nodes of their
common path). All other nodes are final where they are made.

However many conversations share a prefix or are copies, they are split like any
other run. Memory is bounded by ``SHARD_TURNS`` ids of a shard, or by the ids of one
conversation if that is longer (8 bytes a turn, no texts).

Defined cases: rows of a null conversation id belong to no conversation and are left
out; null roles and texts are empty; null turns come first; rows of one turn are
ordered by the md5 of (role, text), a fixed order; repeated rows are turns of their
own; an empty table gives no rows, not even a root; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections import deque
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ordered_index

SHARD_TURNS = 100_000   # turn ids (and conversations) of one search tree
PIECE_IDS = 4_096       # conversation ids in one piece of a boundary node's list
NOTHING = hashlib.sha256(b"").hexdigest()


class TernaryTree:
    """Sequences over ids. Node 0 is the empty prefix; every other node is one id
    behind its parent, and ``lo`` / ``hi`` lead to its smaller / larger siblings."""

    def __init__(self):
        self.key, self.chars, self.parent, self.depth = [None], [0], [-1], [0]
        self.lo, self.eq, self.hi = [-1], [-1], [-1]
        self.ends: list[list[int]] = [[]]

    def _node(self, key: int, chars: int, parent: int) -> int:
        for column, value in ((self.key, key), (self.chars, chars), (self.parent, parent), (self.depth, self.depth[parent] + 1),
                              (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.ends, [])):
            column.append(value)
        return len(self.key) - 1

    def insert(self, ids, chars, members: list[int]) -> None:
        at = 0
        for key, n in zip(ids, chars):
            links, frm, to = self.eq, at, self.eq[at]
            while to >= 0 and self.key[to] != key:
                links, frm = (self.lo, to) if key < self.key[to] else (self.hi, to)
                to = links[frm]
            if to < 0:
                to = links[frm] = self._node(key, n, at)
            at = to
        self.ends[at] += members

    def path(self, ids) -> list[int]:
        """Nodes from the root along a sequence that was inserted."""
        out = [0]
        for key in ids:
            to = self.eq[out[-1]]
            while self.key[to] != key:
                to = self.lo[to] if key < self.key[to] else self.hi[to]
            out.append(to)
        return out

    def totals(self):
        """(members, smallest member, children, leaves, saved) of every node. A
        parent is always made before its children, so one pass from the last
        node to the first adds every subtree up."""
        n = len(self.key)
        members, least = [len(e) for e in self.ends], [min(e, default=None) for e in self.ends]
        children, leaves, saved = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (members[i] - 1) * self.chars[i]
            p = self.parent[i]
            if p >= 0:
                members[p] += members[i]
                least[p] = least[i] if least[p] is None else min(least[p], least[i])
                children[p] += 1
                leaves[p] += leaves[i]
                saved[p] += saved[i]
        return members, least, children, leaves, saved


def median_order(n: int):
    """0..n-1, the middle first, then the middles of the halves."""
    runs = deque([(0, n)])
    while runs:
        lo, hi = runs.popleft()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            runs += ((lo, mid), (mid + 1, hi))


def prefix_keys(ids) -> list[bytes]:
    """Digests of all prefixes of a sequence, the empty one first."""
    h, out = hashlib.md5(), [hashlib.md5().digest()]
    for i in ids:
        h.update(i.to_bytes(8, "little"))
        out.append(h.copy().digest())
    return out


# A row of a shard is a final node, a boundary node's part, a piece of a boundary
# node's list of conversations, or the shard's edges.
NODE, PART, PIECE, EDGE = range(4)
_FIELDS = [("kind", pa.int32()), ("shard", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()),
           ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
           ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
           ("first_ids", pa.list_(pa.int64())), ("last_ids", pa.list_(pa.int64())), ("last_chars", pa.list_(pa.int64()))]
_SCHEMA = ("kind int, shard long, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
           "n_children long, n_leaves long, saved_tokens long, ends string, first_ids array<long>, last_ids array<long>, "
           "last_chars array<long>")


def _batches(rows: list, size: int = 20_000):
    for i in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows[i:i + size]], t) for n, t in _FIELDS],
                                         [n for n, _ in _FIELDS])


def _shard_rows(shard: int, run: list) -> list[dict]:
    """All rows of one shard; ``run``: [(ids, chars, [conversations])], ascending."""
    tree = TernaryTree()
    for i in median_order(len(run)):
        tree.insert(*run[i])
    members, least, children, leaves, saved = tree.totals()
    first, last, last_chars = run[0][0], run[-1][0], run[-1][1]
    edge = {node: key for ids in (first, last) for node, key in zip(tree.path(ids), prefix_keys(ids))}
    out = [{"kind": EDGE, "shard": shard, "first_ids": first, "last_ids": last, "last_chars": last_chars}]
    for i, p in enumerate(tree.parent):
        row = {"kind": NODE, "shard": shard, "conv_id": least[i], "depth": tree.depth[i], "n_convs": members[i], "n_children": children[i],
               "n_leaves": leaves[i], "saved_tokens": saved[i], "parent": edge.get(p)}
        ends = [str(c) for c in tree.ends[i]]
        if i in edge:
            row |= {"kind": PART, "node": edge[i]}
            out += [{"kind": PIECE, "shard": shard, "node": edge[i], "depth": j, "ends": ",".join(ends[j:j + PIECE_IDS])}
                    for j in range(0, len(ends), PIECE_IDS)]
        else:
            row |= {"ends": hashlib.sha256(",".join(ends).encode()).hexdigest(),
                    "parent_conv_id": None if p in edge else least[p]}
        out.append(row)
    return out


def _shards(limit: int):
    def work(batches):
        context = TaskContext.get()
        shard, run, held = (context.partitionId() if context else 0) << 32, [], 0
        for b in batches:
            for ids, chars, conv in zip(*[b.column(c).to_pylist() for c in ("ids", "chars", "conv_id")]):
                if held >= limit:
                    yield from _batches(_shard_rows(shard, run))
                    shard, run, held = shard + 1, [], 0
                if run and run[-1][0] == ids:
                    run[-1][2].append(conv)
                    held += 1
                else:
                    run.append((ids, chars, [conv]))
                    held += 1 + len(ids)
        if run:
            yield from _batches(_shard_rows(shard, run))
    return work


def _corrections(batches):
    """What neighbouring shards both counted. On their common path every node but
    the deepest shares one child; the members of a node lose one per shard in
    (members - 1) x characters where the whole loses one only; and a leaf
    that ends the left shard is counted again, or has children, in the right one."""
    for b in batches:
        rows = []
        for last, chars, following in zip(*[b.column(c).to_pylist() for c in ("last_ids", "last_chars", "next_ids")]):
            common = 0
            while common < min(len(last), len(following)) and last[common] == following[common]:
                common += 1
            keys, saved = prefix_keys(last[:common]), 0
            for d in range(common, -1, -1):
                saved += chars[d - 1] if d else 0
                rows.append({"kind": PART, "node": keys[d], "parent": keys[d - 1] if d else None, "depth": d, "n_convs": 0,
                             "n_children": -1 if d < common else 0, "n_leaves": -1 if len(last) == common else 0, "saved_tokens": saved})
        yield from _batches(rows)


def _list_digests(batches):
    """SHA-256 of each boundary node's list, its pieces read in order as a stream."""
    rows = (r for b in batches for r in zip(b.column("node").to_pylist(), b.column("ends").to_pylist()))
    for node, pieces in groupby(rows, key=lambda r: r[0]):
        h = hashlib.sha256()
        for i, (_, ends) in enumerate(pieces):
            h.update(("," if i else "").encode() + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], ["node", "ends"])


def sequences(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, turns)``: every conversation's turns in order as (id, characters)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = scratch.write(rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", said.alias("said"), F.length(text).cast("long").alias("chars")), "turns")
    # The dictionary has one row per distinct turn, so a turn that opens a third of
    # all conversations meets one row; AQE splits its other side.
    ids = ordered_index(turns.select("said").distinct(), ["said"], scratch, "id")
    placed = F.struct(F.col("turn").isNotNull().alias("later"), "turn", "id", "chars")
    seq = turns.join(ids, "said").groupBy("conv_id").agg(F.array_sort(F.collect_list(placed)).alias("turns"))
    return seq.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def prefix_trie(seq: DataFrame, scratch: Scratch | None = None, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie over ``(conv_id, turns)``, ``turns`` an array of
    (id, chars) structs: ``(conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256)``."""
    scratch = scratch or Scratch(seq.sparkSession, "trie")
    flat = scratch.write(seq.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars")), "sequences")
    rows = scratch.write(flat.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
                         .mapInArrow(_shards(shard_turns), _SCHEMA), "shards")
    # One row per shard: the window over them is bounded by their number.
    edges = (rows.where(F.col("kind") == EDGE)
             .select("last_ids", "last_chars", F.lead("first_ids").over(Window.orderBy("shard")).alias("next_ids")).where("next_ids is not null"))
    parts = rows.where(F.col("kind") == PART).unionByName(edges.mapInArrow(_corrections, _SCHEMA))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = scratch.write(parts.groupBy("node", "depth").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *sums), "merged")
    lists = (rows.where(F.col("kind") == PIECE).select("node", "shard", "depth", "ends").repartition("node")
             .sortWithinPartitions("node", "shard", "depth").mapInArrow(_list_digests, "node binary, ends string"))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))

    def named(df: DataFrame, parent: Column) -> DataFrame:
        return df.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))

    nodes = rows.where(F.col("kind") == NODE)
    return (named(nodes.where("parent is null"), F.col("parent_conv_id"))
            .unionByName(named(nodes.where("parent is not null").join(above, "parent"), F.col("_above")))
            .unionByName(named(merged.join(lists, "node", "left").join(above, "parent", "left"), F.col("_above"))))


def rebuilt(seq: DataFrame) -> DataFrame:
    """Conversation c opens with the first h turns of conversation c - c % 100 and
    goes on with its own behind its first h; h = crc32(c) % 6."""
    heads = seq.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 5).alias("_head"))
    none = F.array().cast(seq.schema["turns"].dataType)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return (seq.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("_head", none), F.lit(1), h), own).alias("turns")))


# crc32 bit by bit, as DuckDB has none.
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), "
        "lambda ch: ascii(ch)::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: k::UBIGINT)), "
        "lambda u, k: xor(u >> 1, CASE WHEN u & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))))")

ORACLE = f"""
WITH own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, CAST({_CRC} % 6 AS BIGINT) AS h FROM own),
built AS (SELECT h.conv_id, list_concat(coalesce(b.s, [])[1:h.h], h.s[h.h + 1:]) AS s
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
pre AS (SELECT conv_id, d AS depth, s[1:d] AS p, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM built)),
node AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM pre GROUP BY p, depth),
kin AS (SELECT n.*, coalesce(k.c, 0) AS n_children, u.conv_id AS parent_conv_id FROM node n
  LEFT JOIN (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS c FROM node WHERE depth > 0 GROUP BY ALL) k
    ON k.p = n.p AND k.depth = n.depth
  LEFT JOIN node u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]),
up AS (SELECT p[1:d] AS p, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
  sum(CASE WHEN len(p) = 0 THEN 0 ELSE (n_convs - 1) * length(p[-1].t) END) AS saved_tokens
  FROM (SELECT p, n_children, n_convs, unnest(range(depth + 1)) AS d FROM kin) GROUP BY ALL)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
  CAST(u.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM kin k JOIN up u ON u.depth = k.depth AND u.p = k.p"""
