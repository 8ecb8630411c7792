"""Property tests: rendering against a plain-Python statement of the rules on
generated matrices; TF-IDF independent of the partition count."""
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartable.functions.render import render_text
from cartable.operators import tfidf as TF

WS = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0       　"


def py_clean(v):
    if v is None:
        return ""
    return re.sub(r"\s+", " ", str(v).strip())


def py_render(t, header_rows=1, header_weight=3, max_cells=200, max_length=None, layout="standard"):
    if not t:
        return ""
    h = min(header_rows, len(t))

    def cells(rows):
        return [py_clean(c) for r in rows if r is not None for c in r if py_clean(c)]

    head = " | ".join(cells(t[:h]))
    if layout == "entetes_seuls":
        txt = head
    else:
        body = " | ".join(cells(t[h:])[:max_cells])
        if layout == "separe":
            txt = f"{head} __CONTENU__ {body}"
        else:
            parts = [head] * header_weight + ([body] if body else [])
            txt = " ".join(p for p in parts if p)
    return txt[:max_length] if max_length else txt


cell = st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab é²" + WS)), max_size=6))
row = st.one_of(st.none(), st.lists(cell, max_size=4))
matrix = st.lists(row, max_size=5)
params = st.fixed_dictionaries({
    "header_rows": st.integers(0, 3), "header_weight": st.integers(0, 3),
    "max_cells": st.integers(0, 4), "max_length": st.one_of(st.none(), st.integers(1, 12)),
    "layout": st.sampled_from(["standard", "entetes_seuls", "separe"]),
})


@settings(max_examples=25, deadline=None)
@given(st.lists(matrix, min_size=1, max_size=8), params)
def test_render_matches_rules(spark, tables, p):
    schema = T.StructType([T.StructField("i", T.IntegerType()),
                           T.StructField("t", T.ArrayType(T.ArrayType(T.StringType())))])
    df = spark.createDataFrame(list(enumerate(tables)), schema)
    out = df.select("i", render_text("t", p["header_rows"], p["header_weight"], p["max_cells"],
                                     p["max_length"], p["layout"]).alias("x")).collect()
    got = {r.i: r.x for r in out}
    for i, t in enumerate(tables):
        assert got[i] == py_render(t, p["header_rows"], p["header_weight"], p["max_cells"],
                                   p["max_length"], p["layout"]), (t, p)


def test_tfidf_independent_of_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("doc_id").alias("id"), "text")
    p = TF.TfidfParams(max_features=500)
    a = TF.tfidf_long(docs.repartition(1), p).select("id", "term", F.round("weight", 12).alias("w"))
    b = TF.tfidf_long(docs.repartition(13), p).select("id", "term", F.round("weight", 12).alias("w"))
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _py_quotas(counts, test_size=0.2, val_size=0.1):
    """Largest-remainder shares (ties by label), train+val first, as stated in
    the split module."""
    import math

    def share(ns, draws):
        tot = sum(ns.values())
        cont = {c: (n / tot) * draws if tot else 0.0 for c, n in ns.items()}
        fl = {c: math.floor(v) for c, v in cont.items()}
        need = draws - sum(fl.values())
        for c in sorted(ns, key=lambda c: (-(cont[c] - fl[c]), c))[:need]:
            fl[c] += 1
        return fl

    n = sum(counts.values())
    tv = share(counts, n - math.ceil(test_size * n))
    n_tv = sum(tv.values())
    tr = share(tv, n_tv - math.ceil((val_size / (1 - test_size)) * n_tv))
    return {c: (tr[c], tv[c] - tr[c], counts[c] - tv[c]) for c in counts}


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from(list("abcdef")), st.integers(1, 60), min_size=1, max_size=5))
def test_split_quotas_and_assignment(spark, counts):
    from cartable.operators import split as S
    rows = [(i, c) for c, n in counts.items() for i in range(n)]
    rows = [(k, c) for k, (i, c) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, label string")
    q = {r.label: (r.n_train, r.n_val, r.n_test) for r in S.split_quotas(df).collect()}
    assert q == _py_quotas(counts)
    got = S.assign_split(df).groupBy("label", "split").count().collect()
    per = {(r.label, r.split): r["count"] for r in got}
    for c, (ntr, nva, nte) in q.items():
        assert (per.get((c, "train"), 0), per.get((c, "val"), 0), per.get((c, "test"), 0)) == (ntr, nva, nte)
