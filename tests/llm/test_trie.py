"""Prefix trie against a plain trie of dictionaries, with shards of any size."""
import hashlib
import math
import random
import zlib

import pytest

from cartable.llm import trie as T
from cartable.llm.common import Scratch, table
from tests.conftest import SF


def plain(convs):
    """convs: {conv_id: [(turn key, characters)]} -> sorted node rows."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def subtree(p):
        stack, out = [p], []
        while stack:
            q = stack.pop()
            out.append(q)
            stack += kids.get(q, [])
        return out

    rows = []
    for p, members in nodes.items():
        below = subtree(p)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        rows.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])),
                     sum(q not in kids for q in below), sum((len(nodes[q]) - 1) * q[-1][1] for q in below if q),
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_query(rows):
    """rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [((r, t), len(t)) for *_, (r, t) in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]  # SQL remainder
    return plain(built)


def test_query_equals_plain_trie(spark):
    from __spark_entry__ import queries
    sf = SF.replace("0.001", "0.01")
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries()["op12_prefix_trie"](spark, sf)) == plain_query(rows)


@pytest.mark.parametrize("limit", [1, 2, 7, 50, 100_000])
@pytest.mark.parametrize("partitions", [1, 8])
def test_any_shard_size_gives_the_same_trie(spark, limit, partitions):
    rnd = random.Random(limit)
    convs = {c: [(k, k % 5) for k in (rnd.choice([1, 1, 1, 2, 3]) for _ in range(rnd.randrange(0, 6)))] for c in range(120)}
    convs |= {500 + c: [(1, 1), (2, 2), (9, 4)] for c in range(80)}       # copies over many shards
    convs[900] = [(1, 1)] * 300                                          # one long path
    convs[901] = [(1, 1)] * 299 + [(2, 2)]
    seq = spark.createDataFrame([(c, t) for c, t in convs.items()], "conv_id long, turns array<struct<id:long,chars:long>>")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = rows_of(T.prefix_trie(seq, Scratch(spark, "t"), shard_turns=limit))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == plain(convs)


def test_nulls_ties_repeats_extra_columns_and_empty_table(spark):
    rnd = random.Random(3)
    rows = [(c, rnd.choice([None, 0, 1, 2, 3]), rnd.choice(["user", None, "", "assistant"]), rnd.choice(["a", "", None, "éb", "long " * 50]))
            for c in [None, 0, 1, 2, 3, 100, 101, 102, 199, 205, 300, -5] for _ in range(rnd.randrange(1, 9))]
    rows += rows[:10]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                               "conv_id long, turn long, role string, text string, ids string, chars int, said string")
    scratch = Scratch(spark, "t")
    assert rows_of(T.prefix_trie(T.rebuilt(T.sequences(df, scratch)), scratch)) == plain_query(rows)
    assert T.prefix_trie(T.rebuilt(T.sequences(df.limit(0), scratch)), scratch).count() == 0


def test_tree_stays_balanced_by_median_insertion():
    tree = T.TernaryTree()
    for i in T.median_order(1023):
        tree.insert([i], [1], [i])

    def deep(i):
        stack, most = [(i, 1)], 0
        while stack:
            j, d = stack.pop()
            if j >= 0:
                most = max(most, d)
                stack += [(tree.lo[j], d + 1), (tree.hi[j], d + 1)]
        return most
    assert deep(tree.eq[0]) == 10
    assert sorted(T.median_order(10)) == list(range(10))
