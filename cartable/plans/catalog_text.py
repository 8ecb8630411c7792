"""Registered queries for sources, rendering, term functions and TF-IDF
(S01, S09, A01, P01-P13, F01-F12, V01-V12). Each has a DuckDB oracle unless
noted."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import render as R
from ..functions import terms as TM
from ..operators import tfidf as TF
from ..sources.tables import class_distribution, decode_matrix
from . import oracle as O
from .adapters import documents_as_tables, read_table
from .registry import register

SEP31 = "\u001f"


def _tables(spark, sf):
    return documents_as_tables(spark, sf)


def _digest(arr):
    """(count, md5 of the elements joined by U+001F) of an array column."""
    return F.size(arr).cast("long"), F.md5(F.array_join(arr, SEP31))


def _sql_digest(lst):
    return f"CAST(len({lst}) AS BIGINT)", f"md5(array_to_string({lst}, chr(31)))"


# ---------------------------------------------------------------- sources
@register("s01_parquet_scan", O.with_tables() +
          "SELECT id, label, CAST(len(table_data) AS BIGINT) AS n_rows, "
          "CAST(len(flatten(table_data)) AS BIGINT) AS n_cells FROM tables")
def s01(spark, sf):
    t = _tables(spark, sf)
    return t.select("id", "label", F.size("table_data").cast("long").alias("n_rows"),
                    F.size(F.flatten("table_data")).cast("long").alias("n_cells"))


@register("s09_decode_matrix", O.with_tables() +
          "SELECT id, CAST(len(table_data) AS BIGINT) AS n_rows, "
          "md5(array_to_string(flatten(table_data), chr(31))) AS cells_md5 FROM tables")
def s09(spark, sf):
    # Encode the matrix as JSON text (as stored at rest) and decode it back.
    t = _tables(spark, sf).select("id", F.to_json("table_data").alias("table_data"))
    d = t.select("id", decode_matrix("table_data").alias("m"))
    return d.select("id", F.size("m").cast("long").alias("n_rows"),
                    F.md5(F.array_join(F.flatten("m"), SEP31)).alias("cells_md5"))


@register("a01_class_distribution",
          "SELECT lang AS label, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def a01(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("lang").alias("label"))
    return class_distribution(d)


# ---------------------------------------------------------------- rendering
@register("p01_clean_cell", O.with_tables(
    f"c AS (SELECT id, list_transform(flatten(table_data), lambda x: {O.clean('x')}) AS cells FROM tables)") +
    "SELECT id, CAST(len(cells) AS BIGINT) AS n_cells, "
    "CAST(len(list_filter(cells, lambda x: x = '')) AS BIGINT) AS n_blank, "
    "md5(array_to_string(cells, chr(31))) AS cells_md5 FROM c")
def p01(spark, sf):
    t = _tables(spark, sf).select("id", F.transform(F.flatten("table_data"), R.clean_cell).alias("cells"))
    return t.select("id", F.size("cells").cast("long").alias("n_cells"),
                    F.size(F.filter("cells", lambda x: x == "")).cast("long").alias("n_blank"),
                    F.md5(F.array_join("cells", SEP31)).alias("cells_md5"))


@register("p02_header_body_split", O.with_tables() +
          f"SELECT id, CAST(len({O.header_rows_sql('table_data', 2)}) AS BIGINT) AS n_header_rows, "
          f"CAST(len({O.body_rows_sql('table_data', 2)}) AS BIGINT) AS n_body_rows FROM tables")
def p02(spark, sf):
    t = _tables(spark, sf)
    return t.select("id", F.size(R.header_rows_of("table_data", 2)).cast("long").alias("n_header_rows"),
                    F.size(R.body_rows_of("table_data", 2)).cast("long").alias("n_body_rows"))


@register("p03_flatten_cells", O.with_tables(
    f"c AS (SELECT id, {O.flat_cells('table_data')} AS cells FROM tables)") +
    "SELECT id, CAST(len(cells) AS BIGINT) AS n_cells, md5(array_to_string(cells, chr(31))) AS cells_md5 FROM c")
def p03(spark, sf):
    t = _tables(spark, sf).select("id", R.flatten_cells("table_data").alias("cells"))
    n, h = _digest(F.col("cells"))
    return t.select("id", n.alias("n_cells"), h.alias("cells_md5"))


@register("p04_cap_cells", O.with_tables(
    f"c AS (SELECT id, {O.cap(O.flat_cells(O.body_rows_sql('table_data', 1)), 5)} AS cells FROM tables)") +
    "SELECT id, CAST(len(cells) AS BIGINT) AS n_cells, md5(array_to_string(cells, chr(31))) AS cells_md5 FROM c")
def p04(spark, sf):
    t = _tables(spark, sf).select(
        "id", R.cap_cells(R.flatten_cells(R.body_rows_of("table_data", 1)), 5).alias("cells"))
    n, h = _digest(F.col("cells"))
    return t.select("id", n.alias("n_cells"), h.alias("cells_md5"))


def _text_out(txt):
    return [F.md5(txt).alias("text_md5"), F.length(txt).cast("long").alias("text_len")]


def _sql_text_out(expr):
    return f"md5({expr}) AS text_md5, CAST(length({expr}) AS BIGINT) AS text_len"


def _render_query(name, **kw):
    sql = O.with_tables(f"r AS (SELECT id, {O.render('table_data', **kw)} AS txt FROM tables)") + \
        f"SELECT id, {_sql_text_out('txt')} FROM r"

    @register(name, sql)
    def q(spark, sf):
        t = _tables(spark, sf).select("id", R.render_text("table_data", **kw).alias("txt"))
        return t.select("id", *_text_out(F.col("txt")))
    return q


@register("p05_join_cells", O.with_tables(f"r AS (SELECT id, {O.header_text('table_data')} AS txt FROM tables)") +
          f"SELECT id, {_sql_text_out('txt')} FROM r")
def p05(spark, sf):
    t = _tables(spark, sf).select("id", R.header_text("table_data").alias("txt"))
    return t.select("id", *_text_out(F.col("txt")))


_render_query("p06_render_standard")
_render_query("p07_render_headers_only", layout="entetes_seuls")
_render_query("p08_render_separe", layout="separe")
_render_query("p09_truncate", max_length=50)
_render_query("p11_render_batch_params", header_rows=2, header_weight=2, max_content_cells=50)


@register("p10_empty_matrix", O.with_tables(f"r AS (SELECT id, {O.render('table_data')} AS txt FROM tables)") +
          f"SELECT id, txt = '' AS is_empty, {_sql_text_out('txt')} FROM r")
def p10(spark, sf):
    r = _tables(spark, sf).select("id", R.render_text("table_data").alias("txt"))
    return r.select("id", (F.col("txt") == "").alias("is_empty"), *_text_out(F.col("txt")))


@register("p13_split_separe", O.with_tables(
    f"r AS (SELECT id, {O.render('table_data', layout='separe')} AS txt FROM tables)",
    "s AS (SELECT id, string_split(txt, '__CONTENU__') AS parts FROM r)",
    f"h AS (SELECT id, {O.strip('parts[1]')} AS header, "
    f"{O.strip(chr(39) + chr(39) + ' || coalesce(array_to_string(list_slice(parts, 2, len(parts)), ' + chr(39) + '__CONTENU__' + chr(39) + '), ' + chr(39) + chr(39) + ')')} AS body FROM s)") +
    "SELECT id, md5(header) AS header_md5, md5(body) AS body_md5 FROM h")
def p13(spark, sf):
    t = _tables(spark, sf).select("id", R.render_text("table_data", layout="separe").alias("txt"))
    h, b = R.split_separated(F.col("txt"))
    return t.select("id", F.md5(h).alias("header_md5"), F.md5(b).alias("body_md5"))


# ---------------------------------------------------------------- terms
def _rendered(spark, sf):
    # Whole texts: the cell cap is a feature of rendering (P04), not of what reads it.
    return _tables(spark, sf).select("id", "label", R.render_text("table_data", max_content_cells=None).alias("text"))


def _spread(spark, sf):
    """``_rendered`` for work inside a row: the documents are dealt out first, so
    there are as many tasks as partitions, not as row groups in the files."""
    t = _tables(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return t.select("id", R.render_text("table_data", max_content_cells=None).alias("text"))


_RENDERED_CTE = f"docs AS (SELECT id, label, {O.render('table_data', max_content_cells=None)} AS text FROM tables)"


@register("f01_lower", O.with_tables(_RENDERED_CTE) + "SELECT id, md5(lower(text)) AS lower_md5 FROM docs")
def f01(spark, sf):
    return _rendered(spark, sf).select("id", F.md5(TM.lower("text")).alias("lower_md5"))


@register("f02_strip_accents")
def f02(spark, sf):
    # Arrow-batched pandas UDF (NFKD + drop combining marks); rows-only check.
    d = read_table(spark, sf, "documents")
    s = d.select("doc_id", TM.strip_accents_unicode(F.lower("text")).alias("t"))
    return s.select("doc_id", F.md5("t").alias("stripped_md5"), F.length("t").cast("long").alias("n_chars"))


def _list_query(name, spark_fn, sql_pre, sql_list):
    """Per document: count and md5 of an array built in two stages (the
    array's input is materialised first, see ``tfidf.analyze_stages``)."""
    sql = O.with_tables(_RENDERED_CTE, f"pre AS (SELECT id, {sql_pre} AS tok FROM docs)") + \
        f"SELECT id, CAST(len({sql_list}) AS BIGINT) AS n_terms, md5(array_to_string({sql_list}, chr(31))) AS terms_md5 FROM pre"

    @register(name, sql)
    def q(spark, sf):
        pre, post = spark_fn
        t = _spread(spark, sf).select("id", pre(F.col("text")).alias("tok"))
        t = t.select("id", post(F.col("tok")).alias("terms"))
        n, h = _digest(F.col("terms"))
        return t.select("id", n.alias("n_terms"), h.alias("terms_md5"))
    return q


_list_query("f03_word_tokens", (lambda t: TM.word_tokens(t), lambda tok: tok), O.word_tokens("text"), "tok")
_list_query("f04_word_ngrams", (lambda t: TM.word_tokens(t), lambda tok: TM.word_ngrams(tok, 1, 3)),
            O.word_tokens("text"), O.ngrams("tok", 1, 3))
_list_query("f05_char_wb_ngrams", (lambda t: F.lower(t), lambda t: TM.char_wb_ngrams(t, 2, 4, lowercase=False)),
            "lower(text)", O.char_wb("tok", 2, 4, lowered=True))
_F06_N = (1, 3)
_F06_SQL = O.with_tables(
    _RENDERED_CTE,
    f"pre AS (SELECT id, {O.char_pre('text')} AS tok FROM docs)",
    "ch AS (SELECT id, unnest(tok) AS c, generate_subscripts(tok, 1) AS pos, len(tok) AS L FROM pre)",
    "g AS (" + " UNION ALL ".join(
        f"SELECT id, {n} AS n, pos, string_agg(c, '') OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW "
        f"AND {n - 1} FOLLOWING) AS gram, L FROM ch" for n in range(_F06_N[0], _F06_N[1] + 1)) + ")",
    "gg AS (SELECT id, count(*) AS n_terms, string_agg(gram, chr(31) ORDER BY n, pos) AS j FROM g "
    "WHERE pos <= L - n + 1 GROUP BY id)") + \
    "SELECT p.id, coalesce(gg.n_terms, 0) AS n_terms, md5(coalesce(gg.j, '')) AS terms_md5 " \
    "FROM pre p LEFT JOIN gg ON p.id = gg.id"


@register("f06_char_ngrams", _F06_SQL)
def f06(spark, sf):
    t = _spread(spark, sf).select("id", TM.normalize_for_char_ngrams("text").alias("tok"))
    t = t.select("id", TM.char_ngram_windows(F.col("tok"), *_F06_N).alias("terms"))
    n, h = _digest(F.col("terms"))
    return t.select("id", n.alias("n_terms"), h.alias("terms_md5"))


def _kw_sql(words):
    return "CAST(" + " OR ".join(f"contains(lower(text), {O.q(w)})" for w in words) + " AS DOUBLE)"


@register("f07_keyword_flags", O.with_tables(_RENDERED_CTE) + "SELECT id, " +
          ", ".join(f"{_kw_sql(ws)} AS kw_{c}" for c, ws in TM.DEFAULT_KEYWORDS.items()) + " FROM docs")
def f07(spark, sf):
    return _rendered(spark, sf).select("id", *TM.keyword_flags(F.col("text")))


_F09_CLASSES = ["en", "fr", "de"]


@register("f09_label_to_id",
          "SELECT lang AS label, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS INTEGER)"
          " AS label_id, count(*) AS n FROM documents GROUP BY ALL")
def f09(spark, sf):
    d = read_table(spark, sf, "documents")
    return (d.select(F.col("lang").alias("label"), TM.label_to_id("lang", _F09_CLASSES).cast("int").alias("label_id"))
            .groupBy("label", "label_id").agg(F.count(F.lit(1)).alias("n")))


@register("f10_id_to_label",
          "SELECT label AS label_id, (['batiment','vehicule','sinistre','autre'])[label + 1] AS label_name, "
          "count(*) AS n FROM embeddings GROUP BY ALL")
def f10(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return (e.select(F.col("label").alias("label_id"), TM.id_to_label("label").alias("label_name"))
            .groupBy("label_id", "label_name").agg(F.count(F.lit(1)).alias("n")))


@register("f11_label_encode",
          "SELECT lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS label_index "
          "FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def f11(spark, sf):
    from pyspark.ml.feature import StringIndexer
    d = read_table(spark, sf, "documents").where(F.col("lang").isNotNull())
    model = StringIndexer(inputCol="lang", outputCol="label_index", stringOrderType="alphabetAsc").fit(d)
    return model.transform(d.select("lang").distinct()).select(F.col("lang").alias("label"), "label_index")


@register("f12_timestamp_display",
          "SELECT event_id, replace(substring(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 1, 19), 'T', ' ') AS shown FROM events")
def f12(spark, sf):
    e = read_table(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select("event_id", TM.display_timestamp(iso).alias("shown"))


# ---------------------------------------------------------------- TF-IDF
_P = TF.TfidfParams()


def _counts(spark, sf, params=_P):
    return TF.term_counts(_rendered(spark, sf), params, carry=["label"])


_COUNTS_CTES = [_RENDERED_CTE, *O.tfidf_ctes("docs", carry="label")]


@register("v01_term_counts", O.with_tables(*_COUNTS_CTES) +
          "SELECT id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_occurrences, max(tf) AS max_tf "
          "FROM counts GROUP BY id")
def v01(spark, sf):
    c = _counts(spark, sf)
    return c.groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_occurrences"),
                               F.max("tf").alias("max_tf"))


@register("v02_document_frequency", O.with_tables(*_COUNTS_CTES) + "SELECT term, df, cf FROM stats")
def v02(spark, sf):
    c = _counts(spark, sf)
    n = _rendered(spark, sf).count()
    return TF.document_frequencies(c, _P, F.lit(n)).select("term", "df", "cf")


_P2K = TF.TfidfParams(max_features=2000)


@register("v03_vocabulary_cap", O.with_tables(_RENDERED_CTE, *O.tfidf_ctes("docs", max_features=2000)) +
          "SELECT term, CAST(idx AS INTEGER) AS idx, df, cf FROM vocab")
def v03(spark, sf):
    docs = _rendered(spark, sf)
    c = TF.term_counts(docs, _P2K)
    return TF.fit_vocabulary(c, docs.count(), _P2K).select("term", F.col("idx").cast("int").alias("idx"), "df", "cf")


@register("v05_sublinear_tf", O.with_tables(*_COUNTS_CTES) +
          "SELECT id, round(sum(1 + ln(tf)), 6) AS sum_log_tf FROM counts GROUP BY id")
def v05(spark, sf):
    c = _counts(spark, sf)
    return c.groupBy("id").agg(F.round(F.sum(TF.tf_weight(F.col("tf"), True)), 6).alias("sum_log_tf"))


@register("v06_smoothed_idf", O.with_tables(*_COUNTS_CTES) + "SELECT term, round(idf, 9) AS idf FROM vocab")
def v06(spark, sf):
    docs = _rendered(spark, sf)
    v = TF.fit_vocabulary(TF.term_counts(docs, _P), docs.count(), _P)
    return v.select("term", F.round("idf", 9).alias("idf"))


@register("v07_l2_norm", O.with_tables(*_COUNTS_CTES) +
          "SELECT r.id, round(sqrt(sum(r.w * r.w)), 6) AS raw_norm, round(sum(t.weight * t.weight), 6) AS unit_norm "
          "FROM raw r JOIN tfidf t ON r.id = t.id AND r.term = t.term GROUP BY r.id")
def v07(spark, sf):
    docs = _rendered(spark, sf)
    c = TF.term_counts(docs, _P)
    v = TF.fit_vocabulary(c, docs.count(), _P)
    # Both norms of a document from one long form: the unit weights are the raw
    # ones over their norm, so one pass gives both.
    raw = TF.transform_counts(c, v, _P, normalize=False)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    both = raw.withColumn("unit", F.col("weight") / norm)
    return both.groupBy("id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("raw_norm"),
                                  F.round(F.sum(F.col("unit") * F.col("unit")), 6).alias("unit_norm"))


@register("v08_tfidf_weights", O.with_tables(*_COUNTS_CTES) +
          "SELECT id, count(*) AS n_terms, round(sum(weight), 6) AS sum_weight, round(max(weight), 6) AS max_weight "
          "FROM tfidf GROUP BY id")
def v08(spark, sf):
    long = TF.tfidf_long(_rendered(spark, sf), _P)
    return long.groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("sum_weight"),
                                  F.round(F.max("weight"), 6).alias("max_weight"))


_HP = TF.TfidfParams(max_features=10000)
_BP = TF.TfidfParams(max_features=5000)


@register("v09_double_tfidf", O.with_tables(
    f"r AS (SELECT id, {O.render('table_data', layout='separe', max_content_cells=None)} AS txt FROM tables)",
    "s AS (SELECT id, string_split(txt, '__CONTENU__') AS parts FROM r)",
    f"hdocs AS (SELECT id, {O.strip('parts[1]')} AS text FROM s)",
    f"bdocs AS (SELECT id, {O.strip(chr(39) + chr(39) + ' || coalesce(array_to_string(list_slice(parts, 2, len(parts)), ' + chr(39) + '__CONTENU__' + chr(39) + '), ' + chr(39) + chr(39) + ')')} AS text FROM s)",
    *O.tfidf_ctes("hdocs", max_features=10000, prefix="h_"),
    *O.tfidf_ctes("bdocs", max_features=5000, prefix="b_"),
    "hv AS (SELECT count(*) AS nh FROM h_vocab)",
    "allw AS (SELECT id, idx, weight, 'header' AS field FROM h_tfidf UNION ALL "
    "SELECT id, idx + (SELECT nh FROM hv), weight, 'body' FROM b_tfidf)") +
    "SELECT id, field, count(*) AS n_terms, CAST(min(idx) AS BIGINT) AS min_idx, round(sum(weight * weight), 6) AS sq "
    "FROM allw GROUP BY id, field")
def v09(spark, sf):
    t = _tables(spark, sf).select("id", R.render_text("table_data", layout="separe", max_content_cells=None).alias("txt"))
    h, b = R.split_separated(F.col("txt"))
    docs = t.select("id", h.alias("header"), b.alias("body"))
    long = TF.double_tfidf_long(docs, _HP, _BP)
    return long.groupBy("id", "field").agg(F.count(F.lit(1)).alias("n_terms"),
                                           F.min("idx").cast("long").alias("min_idx"),
                                           F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("sq"))


@register("v10_feature_union", O.with_tables(*_COUNTS_CTES,
          "kw AS (SELECT id, " + " + ".join(_kw_sql(ws) for ws in TM.DEFAULT_KEYWORDS.values()) + " AS n_kw FROM docs)",
          "tf AS (SELECT id, count(*) AS n, sum(weight) AS s FROM tfidf GROUP BY id)") +
          "SELECT kw.id, CAST(coalesce(tf.n, 0) + kw.n_kw AS BIGINT) AS nnz, "
          "round(coalesce(tf.s, 0) + kw.n_kw, 6) AS total FROM kw LEFT JOIN tf ON kw.id = tf.id")
def v10(spark, sf):
    from ..operators.features import feature_union_long
    docs = _rendered(spark, sf)
    long = feature_union_long(docs, _P)
    kept = long.where(F.col("weight") != 0)
    agg = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("s"))
    return (docs.select("id").join(agg, "id", "left")
            .select("id", F.coalesce("n", F.lit(0)).cast("long").alias("nnz"),
                    F.round(F.coalesce("s", F.lit(0.0)), 6).alias("total")))


@register("v12_sparse_vectors", O.with_tables(*_COUNTS_CTES,
          "tf AS (SELECT id, count(*) AS n, sum(weight * weight) AS s FROM tfidf WHERE weight <> 0 GROUP BY id)") +
          "SELECT d.id, CAST(coalesce(tf.n, 0) AS BIGINT) AS nnz, round(coalesce(tf.s, 0), 6) AS sq "
          "FROM docs d LEFT JOIN tf ON d.id = tf.id")
def v12(spark, sf):
    docs = _rendered(spark, sf)
    model = TF.fit_tfidf(docs, _P)
    long = model.transform(docs)
    vec = TF.sparse_rows(long, docs.select("id"), model.size)

    # Over the stored entries: as a dense array a vector has a value per vocabulary term.
    @F.udf("nnz long, sq double", useArrow=False)
    def entries(v):
        x = v.values
        return int((x != 0).sum()), float((x * x).sum())

    return vec.select("id", entries("features").alias("e")).select("id", "e.nnz", F.round("e.sq", 6).alias("sq"))


# ---------------------------------------------------------------- lemmas
_LEMMA_CTES = [
    _RENDERED_CTE,
    f"ltk AS (SELECT id, {O.word_tokens('text')} AS tok FROM docs)",
    "ltoks AS (SELECT id, unnest(tok) AS form, generate_subscripts(tok, 1) AS pos FROM ltk)",
    "forms AS (SELECT DISTINCT form FROM ltoks)",
    "dict AS (SELECT form, substring(form, 1, length(form) - 1) AS lemma FROM forms "
    "WHERE length(form) >= 4 AND regexp_matches(form, '[sx]$') "
    "AND substring(form, 1, length(form) - 1) IN (SELECT form FROM forms))",
    "lem0 AS (SELECT t.id, string_agg(coalesce(d.lemma, t.form), ' ' ORDER BY t.pos) AS text "
    "FROM ltoks t LEFT JOIN dict d ON t.form = d.form GROUP BY t.id)",
    "lem AS (SELECT d.id, coalesce(l.text, '') AS text FROM docs d LEFT JOIN lem0 l ON d.id = l.id)",
]


@register("f08_lemmatize", O.with_tables(*_LEMMA_CTES) +
          "SELECT id, md5(text) AS lemma_md5, CAST(length(text) AS BIGINT) AS text_len FROM lem")
def f08(spark, sf):
    from ..operators.features import lemmatize, plural_lemma_dictionary
    docs = _rendered(spark, sf)
    lem = lemmatize(docs, plural_lemma_dictionary(docs))
    return lem.select("id", F.md5("text").alias("lemma_md5"), F.length("text").cast("long").alias("text_len"))


@register("v11_lemma_tfidf", O.with_tables(*_LEMMA_CTES, *O.tfidf_ctes("lem")) +
          "SELECT id, count(*) AS n_terms, round(sum(weight), 6) AS sum_weight FROM tfidf GROUP BY id")
def v11(spark, sf):
    from ..operators.features import lemmatized_tfidf_long
    long = lemmatized_tfidf_long(_rendered(spark, sf), _P)
    return long.groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("sum_weight"))


# ------------------------------------------------------- conversations
@register("p06_render_conversations",
          "WITH c AS (SELECT conv_id AS id, list([role, text] ORDER BY turn) AS table_data FROM conversations "
          f"GROUP BY conv_id), r AS (SELECT id, {O.render('table_data')} AS txt FROM c) "
          f"SELECT id, {_sql_text_out('txt')}, CAST(len(table_data) AS BIGINT) AS n_turns FROM r JOIN c USING (id)")
def p06c(spark, sf):
    from .adapters import conversation_texts
    r = conversation_texts(spark, sf)
    return r.select("id", *_text_out(F.col("text")), "n_turns")
