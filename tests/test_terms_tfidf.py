"""Term functions (F01-F12) and TF-IDF (V01-V12) against literal fixtures and
an independent pure-Python recomputation."""
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from cartable.functions import terms as TM
from cartable.operators import tfidf as TF


def one(spark, value, fn, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(fn(F.col("t")).alias("x")).first()["x"]


def test_word_tokens(spark):
    assert one(spark, "Surface (m²) a N° 1 x_1", TM.word_tokens) == ["surface", "m²", "x_1"]


def test_word_ngrams(spark):
    out = one(spark, ["a1", "b2", "c3"], lambda c: TM.word_ngrams(c, 1, 2), "t array<string>")
    assert out == ["a1", "b2", "c3", "a1 b2", "b2 c3"]
    assert one(spark, ["a"], lambda c: TM.word_ngrams(c, 1, 3), "t array<string>") == ["a"]
    assert one(spark, [], lambda c: TM.word_ngrams(c, 2, 2), "t array<string>") == []


def _py_char_wb(text, lo, hi):
    out = []
    for w in text.lower().split():
        w = " " + w + " "
        for n in range(lo, hi + 1):
            off = 0
            out.append(w[off:off + n])
            while off + n < len(w):
                off += 1
                out.append(w[off:off + n])
            if off == 0:
                break
    return out


def test_char_wb(spark):
    assert one(spark, "ab", lambda c: TM.char_wb_ngrams(c, 2, 3)) == [" a", "ab", "b ", " ab", "ab "]
    assert one(spark, "a", lambda c: TM.char_wb_ngrams(c, 3, 4)) == [" a "]
    for text in ["Le bâtiment  A b", "x", "", "abc de fghij", "un deux trois"]:
        for lo, hi in [(1, 1), (2, 4), (3, 5), (1, 3)]:
            assert one(spark, text, lambda c: TM.char_wb_ngrams(c, lo, hi)) == _py_char_wb(text, lo, hi)


def _py_char(text, lo, hi):
    t = re.sub(r"\s\s+", " ", text.lower())
    return [t[i:i + n] for n in range(lo, min(hi + 1, len(t) + 1)) for i in range(len(t) - n + 1)]


def test_char_ngrams(spark):
    for text in ["ab  cd", "a", "", "Été à\tParis"]:
        assert one(spark, text, lambda c: TM.char_ngrams(c, 1, 3)) == _py_char(text, 1, 3)


def test_keyword_flags(spark):
    df = spark.createDataFrame([("liste des voitures",), ("Surface du LOCAL",)], "t string")
    rows = df.select(*TM.keyword_flags(F.col("t"))).collect()
    assert (rows[0]["kw_batiment"], rows[0]["kw_vehicule"], rows[0]["kw_sinistre"]) == (0.0, 1.0, 0.0)
    assert rows[1]["kw_batiment"] == 1.0


def test_label_maps(spark):
    assert one(spark, "xyz", TM.label_to_id) == 3
    assert one(spark, "vehicule", TM.label_to_id) == 1
    assert one(spark, 2, TM.id_to_label, "t int") == "sinistre"
    assert one(spark, 9, TM.id_to_label, "t int") is None


def test_display_timestamp(spark):
    assert one(spark, "2024-01-02T03:04:05.123456", TM.display_timestamp) == "2024-01-02 03:04:05"


def test_strip_accents(spark):
    assert one(spark, "Élément façade", TM.strip_accents_unicode) == "Element facade"


def test_values_v05_v06():
    assert math.isclose(1 + math.log(3), 2.09861228866811)
    assert math.isclose(TF.sklearn_idf(3, 2), math.log(4 / 3) + 1)


DOCS = [
    (1, "le chat dort le chat"),
    (2, "le chien dort"),
    (3, "un chat et un chien"),
    (4, "rien"),
]


def _py_tfidf(docs, min_df=1, max_features=None, ngram=(1, 2)):
    toks = {i: re.findall(r"[^\W]{2,}", t.lower()) for i, t in docs}
    grams = {}
    for i, tk in toks.items():
        g = []
        for n in range(ngram[0], ngram[1] + 1):
            g += [" ".join(tk[j:j + n]) for j in range(len(tk) - n + 1)]
        grams[i] = Counter(g)
    df = Counter(t for c in grams.values() for t in c)
    cf = Counter()
    for c in grams.values():
        cf.update(c)
    vocab = [t for t in df if df[t] >= min_df]
    if max_features:
        vocab = sorted(vocab, key=lambda t: (-cf[t], t))[:max_features]
    n = len(docs)
    out = {}
    for i, c in grams.items():
        w = {t: (1 + math.log(c[t])) * (math.log((1 + n) / (1 + df[t])) + 1) for t in c if t in vocab}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            out[(i, t)] = v / norm
    return out


def test_tfidf_matches_python(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    for min_df, mf in [(1, None), (2, None), (1, 3)]:
        p = TF.TfidfParams(min_df=min_df, max_features=mf)
        got = {(r.id, r.term): r.weight for r in TF.tfidf_long(docs, p).collect()}
        exp = _py_tfidf(DOCS, min_df, mf)
        assert got.keys() == exp.keys()
        for k in exp:
            assert math.isclose(got[k], exp[k], rel_tol=1e-9)


def test_fit_then_transform_unseen_terms(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    model = TF.fit_tfidf(docs, TF.TfidfParams(min_df=1))
    new = spark.createDataFrame([(9, "zzz chat"), (10, "qqq")], "id long, text string")
    rows = model.transform(new).collect()
    assert {r.term for r in rows} == {"chat"}
    assert math.isclose(rows[0].weight, 1.0)


def test_empty_vocabulary_is_error(spark):
    import pytest
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
    with pytest.raises(ValueError):
        TF.fit_tfidf(docs, TF.TfidfParams(min_df=1))


def test_vocab_join_is_broadcast(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    plan = TF.tfidf_long(docs, TF.TfidfParams(min_df=1))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_sparse_vectors_keep_empty_docs(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    model = TF.fit_tfidf(docs, TF.TfidfParams(min_df=2))
    vec = TF.sparse_rows(model.transform(docs), docs.select("id"), model.size)
    rows = {r.id: r.features for r in vec.collect()}
    assert len(rows) == 4 and rows[4].numNonzeros() == 0
    assert math.isclose(rows[1].norm(2), 1.0)


def test_eager_exact_cut_equals_lazy_limit(spark):
    from pyspark.sql import functions as F2
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F2.col("doc_id").alias("id"), "text")
    for mf in (50, 777):
        p = TF.TfidfParams(max_features=mf)
        eager = TF.fit_tfidf(docs, p).vocab.select("term", "idx", "df", "cf")
        lazy = TF.fit_vocabulary(TF.term_counts(docs, p), docs.count(), p).select("term", "idx", "df", "cf")
        assert eager.count() == mf
        assert eager.exceptAll(lazy).count() == 0 and lazy.exceptAll(eager).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_stay_in_their_row_and_merge_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "aa bb"), (2, "cc"), (3, ""), (4, None), (None, "dd"), (None, "dd dd")],
                                 "id long, text string")
    counts = TF.term_counts(docs, TF.TfidfParams())
    assert {(r.id, r.term): r.tf for r in counts.collect()} == {
        (1, "aa"): 3, (1, "bb"): 2, (1, "aa bb"): 2, (1, "bb aa"): 1, (2, "cc"): 1, (None, "dd"): 3, (None, "dd dd"): 1}
    # No hash table over (id, term), and no partition merged with others as the input grows.
    assert "Aggregate" not in _plan(counts)
    assert counts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_char_windows_by_code_points_without_slices(spark):
    text = "a\U0001F600b\né\U0001F601"
    df = spark.createDataFrame([(text,)], "t string").select(TM.char_ngram_windows("t", 1, 3).alias("x"))
    assert df.first()["x"] == [text[i:i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]
    assert "slice(" not in _plan(df)


def _documents(spark, folder, texts):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_gram_queries_deal_out_one_file(spark, tmpdir_path):
    from cartable.plans.registry import all_queries
    sf = _documents(spark, tmpdir_path, [f"ab cd{i}" for i in range(64)])
    for name in ("f05_char_wb_ngrams", "f06_char_ngrams"):
        q = all_queries()[name](spark, sf)
        assert q.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert q.count() == 64


def test_sparse_vectors_are_not_built_or_read_in_large_batches(spark, tmpdir_path):
    from cartable.plans.registry import all_queries
    sf = _documents(spark, tmpdir_path, ["un chat dort", "un chat mange", "", "seul"])
    q = all_queries()["v12_sparse_vectors"](spark, sf)
    assert "ArrowEvalPython" not in _plan(q) and "vector_to_array" not in _plan(q)
    got = {r.id: (r.nnz, r.sq) for r in q.collect()}
    assert got == {0: (3, 1.0), 1: (3, 1.0), 2: (0, 0.0), 3: (0, 0.0)}


def test_counts_in_tasks_equal_the_terms_of_columns(spark):
    from pyspark.sql import functions as F2
    docs = spark.createDataFrame([(1, "Le chat été_2 dort, le chat"), (1, "le\tchat x"), (2, "a"), (3, ""), (4, None), (None, "dd ee"), (None, "dd"),
                                  (5, "\U0001F600 b c d　Éléphant"), (6, "un deux trois quatre")], "id long, text string")
    for kw in ({"ngram_range": (1, 3)}, {"ngram_range": (2, 2)}, {"analyzer": "char_wb", "ngram_range": (2, 4)}, {"strip_accents": "unicode"}):
        p = TF.TfidfParams(min_df=1, **kw)
        old = TF.term_counts(docs, p)
        staged = TF.staged_texts(docs, p)
        stats = lambda df: sorted(map(tuple, df.select("term", "df", "cf").collect()))
        assert stats(TF.term_statistics(staged, p)) == stats(TF.document_frequencies(old, p, F2.lit(9)))
        terms = sorted({r.term for r in old.collect()})
        known = TF.known_counts(staged, p, terms, ["id"]).select("id", F2.inline("cells"))
        key = lambda r: (r[0] is not None, r)
        assert sorted(((r.id, terms[r.idx], r.tf) for r in known.collect()), key=key) == sorted(((r.id, r.term, r.tf) for r in old.collect()), key=key)


def test_training_makes_rows_of_known_terms_only(spark):
    docs = spark.createDataFrame([(i, f"commun rare{i} unique{i}") for i in range(20)] + [(20, ""), (20, "commun")], "id long, text string")
    model = TF.fit_tfidf(docs, TF.TfidfParams(max_features=3, min_df=1))
    new, old = model.features(docs), model.transform(docs).select("id", "idx", "weight")
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
    assert "regexp_extract_all" in _plan(new) and "sort_array" not in _plan(new)


def test_statistics_outside_each_part_come_from_one_pass(spark):
    from pyspark.sql import functions as F2
    docs = spark.createDataFrame([(i, f"mot{i % 3} commun", i % 3) for i in range(9)], "id long, text string, fold int")
    p = TF.TfidfParams(min_df=1)
    wide = {r.term: r for r in TF.statistics_outside(TF.staged_texts(docs, p, carry=["fold"]), p, "fold", 3).collect()}
    for f in range(3):
        one = TF.document_frequencies(TF.term_counts(docs.where(F2.col("fold") != f), p), p, F2.lit(6)).collect()
        assert {r.term: (r.df, r.cf) for r in one} == {t: (r[f"df_{f}"], r[f"cf_{f}"]) for t, r in wide.items() if r[f"df_{f}"]}


def test_lemmas_in_tasks_equal_the_join(spark, monkeypatch):
    from cartable.operators import features as FE
    docs = spark.createDataFrame([(1, "Les chats, des Choix et le chat"), (1, "chats ici"), (2, "choi maisons"), (3, ""), (4, None), (None, "chats")],
                                 "id long, text string")
    d = FE.plural_lemma_dictionary(docs)
    assert sorted(map(tuple, d.collect())) == [("chats", "chat"), ("choix", "choi")]
    assert _plan(d).count("regexp_extract_all") <= 2  # one pass over the texts (a plan may print it twice)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    new = FE.lemmatize(docs, d)
    assert "Generate" not in _plan(new)  # no row per token
    got = rows(new)
    monkeypatch.setattr(FE, "SHIPPED_DICT_MAX_ROWS", 0)
    assert got == rows(FE.lemmatize(docs, d))
    assert FE.lemmatized_tfidf_long(docs.where("id = 3"), TF.TfidfParams()).count() == 0


def test_vectors_of_known_terms_keep_the_gathered_order(spark):
    docs = spark.createDataFrame([(i, f"commun mot{i % 7}") for i in range(300)], "id long, text string")
    model = TF.fit_tfidf(docs, TF.TfidfParams(min_df=1))
    old = TF.sparse_rows(model.transform(docs).select("id", "idx", "weight"), docs.select("id"), model.size).collect()
    new = TF.sparse_rows(model.features(docs), docs.select("id"), model.size)
    assert "SortMergeJoin" in _plan(new)
    assert sorted((r.id, r.features) for r in new.collect()) == sorted((r.id, r.features) for r in old)
