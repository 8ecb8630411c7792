"""The pipeline against a brute-force one on a small table."""
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from cartable.llm import toxicity

from .test_dedup import brute

SF = "/root/testdata/sf0.001"
LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(spark, docs, sf_dir):
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if not scores[r.doc_id]]
    group = brute(rows, cp.SHINGLE, cp.PERCENT)
    rows = [(i, t) for i, t in rows if group[i][1] == i]
    word = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    items = [grams(word(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(len(g & grams(word(t))) >= 0.6 * len(g) for g in items)]
    return {(i, np.array(LIB.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in rows}


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = cp.run(spark, SF).collect()
    assert {(r.doc_id, bytes(r.ids)) for r in got} == expected(spark, docs, SF)
    assert all(r.round_trip and r.n_tokens == len(r.ids) // 4 for r in got) and len(got) < docs.count()


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, None, "a", 1, "k"), (2, "", "a", 1, "k"), (3, " \n", None, None, "k"), (4, "six words are more than five", "b", 2, "k"),
            (4, "six words are more than five", "b", 2, "k"), (5, "six words are more than five", "b", 2, "k"),
            (None, "six words are more than five", "b", 2, "k"), (6, "z " * 100_000, "b", 2, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, component bigint, digest string")
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    names = [n for n, _ in cp.STAGES]
    kept = sorted(str(r.doc_id) for r in cp.STAGES[names.index("near_duplicates")][1](spark, docs, SF).collect())
    assert kept == ["1", "2", "3", "4", "6", "None"]
