"""op2, op3: against brute force, with the edge cases of their docstrings."""
import random
import re

import numpy as np
import pytest

from cartable.llm import embed, minhash
from cartable.llm.common import Scratch, connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, component string, digest string, keys string"


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if (c := len(sets[a] & sets[b])) and 100 * c >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), g) for i, g in groups(ids, links).items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def made(seed, n=120):
    """Copies with a few words changed, so pairs fall on both sides of a threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80), (3, 40)])
def test_minhash_equals_brute_force(spark, k, percent):
    rows = made(k * percent)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(minhash.near_duplicates(df, k, percent)) == brute(rows, k, percent)


def test_minhash_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # one word of sixty changed: linked to the base, not always to each other
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        if i % 3 == 0:
            w[rng.randrange(60)] = f"y{i}"
        rows.append((100 - i, " ".join(w)))
    rows.append((500, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(minhash.near_duplicates(df, 3, 88)) == brute(rows, 3, 88)


def test_minhash_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = minhash.near_duplicates(df, 3, 85)
    assert result(out) == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_minhash_edges(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, "a b c"), (7, "a b c"),
            (None, "a b c"), (8, long), (9, long + " end"), (10, "x" * 3_000_000)]
    df = spark.createDataFrame([(i, t, "c", "d", "k") for i, t in rows], DOCS)
    got = [tuple(r) for r in minhash.near_duplicates(df, 3, 85).collect()]
    assert len(got) == len(rows)
    assert {g for g in got if g[0] in (1, 2, 3)} == {(i, 0, i, True) for i in (1, 2, 3)}
    assert {g for g in got if g[0] in (4, 5)} == {(4, 1, 4, True), (5, 1, 4, False)}
    assert sorted(g for g in got if g[0] in (6, 7)) == [(6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False)]
    assert [g for g in got if g[0] is None] == [(None, 1, None, True)]
    assert {g[2] for g in got if g[0] in (8, 9)} == {8}
    assert minhash.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_signature_values_agree_as_often_as_sets_overlap():
    s = minhash.Shingler(1)
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.concatenate([a[:2000], np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))])
    sig = minhash.MinMax(50, 4).signatures([a, np.unique(b)])
    true = 2000 / (len(a) + len(b) - 2000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.12
    assert (s.sets(["a b", "A  B", "b a"])[0] == s.sets(["a b", "A  B"])[1]).all()


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)]
    want = groups({x for e in edges if e[0] != e[1] for x in e}, edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == want
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_components_take_no_round_to_find_that_nothing_changes(spark):
    stars = [(i, i - i % 10) for i in range(200)] * 3
    scratch = Scratch(spark, "t")
    got = connected_components(spark.createDataFrame(stars, "a bigint, b bigint"), scratch).collect()
    assert sorted(map(tuple, got)) == [(i, i - i % 10) for i in range(200)]
    assert scratch._n == 1  # tables written
    # One lower neighbour each: a path of pointers halves with every table.
    scratch = Scratch(spark, "t")
    path = spark.createDataFrame([(i + 1, i) for i in range(64)], "a bigint, b bigint")
    assert {tuple(r) for r in connected_components(path, scratch).collect()} == {(i, 0) for i in range(65)}
    assert scratch._n <= 7


def brute_vectors(rows, threshold):
    ok = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]
    g = groups([i for i, _ in rows], links)
    return {i: (sum(i in e for e in links), g[i]) for i, _ in rows}


@pytest.mark.parametrize("tile_rows", [4096, 16])
def test_vectors_equal_brute_force(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(embed, "TILE_ROWS", tile_rows)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.6])]) for i in range(300)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 15 + [None]), (2004, [float("nan")] * 16),
             (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1e200] * 16), (2009, [1e-200] * 16)]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id bigint, embedding array<double>, rep int, added string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicate_vectors(df).collect()}
    assert got == brute_vectors([(i, v if v is None or i < 2008 else [1.0] * 16) for i, v in rows], 0.95)


def test_vectors_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    got = sorted(map(tuple, embed.near_duplicate_vectors(df).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
    assert embed.near_duplicate_vectors(df.limit(0)).count() == 0


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 24))
    x[200:] = x[:200] + rng.normal(size=(200, 24)) * 0.25
    u = embed._unit(x)
    p = embed.Tiles(x, 0).project(x)
    i, j = embed.near_pairs(u, p, u, p, 0.9)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(np.einsum("id,jd->ij", u, u) >= 0.9)), strict=True))
