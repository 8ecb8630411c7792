"""Registered queries for splits and folds (W01-W08), metrics (A02-A11, A14),
ranking and probabilities (T01, T02, M10, M12)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import split as S
from ..operators.ranking import argmax_label, ranked_probabilities, softmax
from .adapters import label_pairs_orders, label_pairs_quality, read_table
from .registry import register


def _labelled(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))


_DOCS = "d AS (SELECT doc_id AS id, lang AS label FROM documents)"


def _lr_sql(src: str, n_col: str, draws: str, out: str) -> str:
    """Largest-remainder allocation over a per-class table (SQL twin of
    ``split._largest_remainder``)."""
    cont = f"(CAST({n_col} AS DOUBLE) / sum({n_col}) OVER ()) * {draws}"
    return (f"SELECT *, CAST(fl + CASE WHEN row_number() OVER (ORDER BY cont - fl DESC, label) <= "
            f"{draws} - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS {out} "
            f"FROM (SELECT *, {cont} AS cont, floor({cont}) AS fl FROM {src})")


def quota_ctes(src: str = "d", test: float = 0.2, val: float = 0.1, stratify: bool = True) -> list[str]:
    key = "label" if stratify else "'__all__'"
    rel = float(val) / (1.0 - float(test))
    return [
        f"cnt AS (SELECT {key} AS label, count(*) AS n FROM {src} GROUP BY 1)",
        f"c1 AS (SELECT label, n, sum(n) OVER () - ceil(CAST({test!r} AS DOUBLE) * sum(n) OVER ()) AS dtv FROM cnt)",
        f"q1 AS (SELECT label, n, n_tv, n - n_tv AS n_test FROM ({_lr_sql('c1', 'n', 'dtv', 'n_tv')}))",
        f"c2 AS (SELECT *, sum(n_tv) OVER () - ceil(CAST({rel!r} AS DOUBLE) * sum(n_tv) OVER ()) AS dtr FROM q1)",
        f"quotas AS (SELECT label, n, n_train, n_tv - n_train AS n_val, n_test "
        f"FROM ({_lr_sql('c2', 'n_tv', 'dtr', 'n_train')}))",
    ]


def split_sql_ctes(src: str = "d", stratify: bool = True, seed: int = 42) -> list[str]:
    part = "PARTITION BY label" if stratify else ""
    key = "label" if stratify else "'__all__'"
    return [
        *quota_ctes(src, stratify=stratify),
        f"rk AS (SELECT id, label, row_number() OVER ({part} ORDER BY md5(CAST(id AS VARCHAR) || '-{seed}'), id) AS r, "
        f"{key} AS k FROM {src})",
        "sp AS (SELECT rk.id, rk.label, CASE WHEN r <= q.n_test THEN 'test' WHEN r <= q.n_test + q.n_val "
        "THEN 'val' ELSE 'train' END AS split FROM rk JOIN quotas q ON rk.k = q.label)",
    ]


def _with(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


@register("w01_stratified_split", _with(_DOCS, *split_sql_ctes()) + "SELECT id, label, split FROM sp")
def w01(spark, sf):
    return S.assign_split(_labelled(spark, sf)).select("id", "label", "split")


@register("w02_split_quotas", _with(_DOCS, *quota_ctes()) + "SELECT label, n, n_train, n_val, n_test FROM quotas")
def w02(spark, sf):
    return S.split_quotas(_labelled(spark, sf))


@register("w03_unstratified_split", _with(_DOCS, *split_sql_ctes(stratify=False)) + "SELECT id, label, split FROM sp")
def w03(spark, sf):
    return S.assign_split(_labelled(spark, sf), stratify=False).select("id", "label", "split")


_FOLD_CTES = [
    _DOCS,
    "rk AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id) AS r FROM d)",
    "off AS (SELECT label, sum(n) OVER (ORDER BY label) - n AS o FROM (SELECT label, count(*) AS n FROM d GROUP BY label))",
    "folds AS (SELECT rk.id, rk.label, CAST((r - 1 + o) % 5 AS INTEGER) AS fold FROM rk JOIN off USING (label))",
]


@register("w04_stratified_kfold", _with(*_FOLD_CTES) + "SELECT id, label, fold FROM folds")
def w04(spark, sf):
    return S.assign_folds(_labelled(spark, sf), k=5).select("id", "label", "fold")


@register("w05_fold_complement", _with(*_FOLD_CTES) +
          "SELECT f.fold, l.label, l.n - coalesce(c.n, 0) AS n_train FROM (SELECT DISTINCT fold FROM folds) f "
          "JOIN (SELECT label, count(*) AS n FROM folds GROUP BY label) l ON true "
          "LEFT JOIN (SELECT fold, label, count(*) AS n FROM folds GROUP BY ALL) c ON c.fold = f.fold AND c.label = l.label")
def w05(spark, sf):
    folded = S.assign_folds(_labelled(spark, sf), k=5)
    # Training rows of every fold: the complement of the fold, per class.
    parts = [S.fold_train(folded, f).groupBy("label").agg(F.count(F.lit(1)).alias("n_train")).select(
        F.lit(f).alias("fold"), "label", "n_train") for f in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("w06_union_train_val", _with(_DOCS, *split_sql_ctes()) +
          "SELECT label, count(*) AS n FROM (SELECT * FROM sp WHERE split = 'train' UNION ALL "
          "SELECT * FROM sp WHERE split = 'val') GROUP BY label")
def w06(spark, sf):
    tr, va, _ = S.split_frames(_labelled(spark, sf))
    return S.union_train_val(tr, va).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_SOURCES = ["src1", "src3", "src5"]


@register("w07_isin_filter",
          "SELECT source, lang AS label, count(*) AS n FROM documents WHERE source IN ('src1', 'src3', 'src5') GROUP BY ALL")
def w07(spark, sf):
    d = read_table(spark, sf, "documents")
    return (d.where(F.col("source").isin(_SOURCES)).groupBy("source", F.col("lang").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("w08_null_filter",
          "SELECT quality, count(*) AS n FROM (SELECT d.doc_id, l.quality FROM documents d "
          "LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE quality IS NOT NULL GROUP BY quality")
def w08(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    return (d.join(lab, "doc_id", "left").na.drop(subset=["quality"])
            .groupBy("quality").agg(F.count(F.lit(1)).alias("n")))


@register("a02_split_sizes", _with(_DOCS, *split_sql_ctes()) +
          "SELECT split, count(*) AS n FROM sp GROUP BY ROLLUP (split)")
def a02(spark, sf):
    return M.split_sizes(S.assign_split(_labelled(spark, sf)))


@register("a03_class_weights", _with(_DOCS) +
          "SELECT label, count(*) AS n_c, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight "
          "FROM d GROUP BY label")
def a03(spark, sf):
    w = M.class_weights(_labelled(spark, sf))
    return w.select("label", "n_c", F.round("weight", 9).alias("weight"))


# ------------------------------------------------------------- metrics
_ORD = ("o AS (SELECT o_orderkey AS id, o_orderstatus AS y, CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2') "
        "THEN 'F' WHEN substring(o_orderpriority, 1, 1) = '3' THEN 'O' ELSE 'P' END AS p FROM orders)")
_CLASSES = ["F", "O", "P", "Q"]  # Q never occurs: a configured class with no rows


@register("a04_accuracy", _with(_ORD) + "SELECT round(avg(CAST(y = p AS DOUBLE)), 6) AS accuracy FROM o")
def a04(spark, sf):
    return M.accuracy(label_pairs_orders(spark, sf)).select(F.round("accuracy", 6).alias("accuracy"))


def _prf_sql(src: str, classes: list[str]) -> str:
    dim = " UNION ALL ".join(f"SELECT '{c}' AS label, {i} AS class_idx" for i, c in enumerate(classes))
    return (f"cls AS ({dim}), "
            f"st AS (SELECT cls.label, cls.class_idx, "
            f"coalesce(sum(CASE WHEN {src}.y = cls.label AND {src}.p = cls.label THEN 1 ELSE 0 END), 0) AS tp, "
            f"coalesce(sum(CASE WHEN {src}.y = cls.label THEN 1 ELSE 0 END), 0) AS nt, "
            f"coalesce(sum(CASE WHEN {src}.p = cls.label THEN 1 ELSE 0 END), 0) AS np "
            f"FROM cls LEFT JOIN {src} ON {src}.y = cls.label OR {src}.p = cls.label GROUP BY cls.label, cls.class_idx)")


def _prf_cols() -> str:
    return ("round(CASE WHEN np = 0 THEN 0 ELSE tp / np END, 6) AS precision, "
            "round(CASE WHEN nt = 0 THEN 0 ELSE tp / nt END, 6) AS recall, "
            "round(CASE WHEN nt + np = 0 THEN 0 ELSE 2.0 * tp / (nt + np) END, 6) AS f1, CAST(nt AS BIGINT) AS support")


@register("a05_per_class_report", _with(_ORD, _prf_sql("o", _CLASSES)) +
          f"SELECT label, CAST(class_idx AS INTEGER) AS class_idx, {_prf_cols()} FROM st")
def a05(spark, sf):
    r = M.per_class_report(label_pairs_orders(spark, sf), _CLASSES)
    return r.select("label", "class_idx", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _summary_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return (f"lab AS (SELECT {g}y AS label, 1 AS t, 0 AS pr, CAST(y = p AS INT) AS tp FROM {src} "
            f"UNION ALL SELECT {g}p, 0, 1, 0 FROM {src}), "
            f"ls AS (SELECT {g}label, sum(tp) AS tp, sum(t) AS nt, sum(pr) AS np FROM lab GROUP BY ALL), "
            f"lf AS (SELECT *, CASE WHEN nt + np = 0 THEN 0 ELSE 2.0 * tp / (nt + np) END AS f1 FROM ls), "
            f"summ AS (SELECT {g}CAST(sum(nt) AS BIGINT) AS n, sum(tp) / sum(nt) AS accuracy, avg(f1) AS macro_f1, "
            f"sum(f1 * nt) / sum(nt) AS weighted_f1 FROM lf {gb})")


@register("a06_macro_f1", _with(_ORD, _summary_sql("o")) + "SELECT n, round(macro_f1, 6) AS macro_f1 FROM summ")
def a06(spark, sf):
    s = M.summary_metrics(label_pairs_orders(spark, sf))
    return s.select("n", F.round("macro_f1", 6).alias("macro_f1"))


_QUAL = "o AS (SELECT doc_id AS id, CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS p FROM labels)"


@register("a07_weighted_f1", _with(_QUAL, _summary_sql("o")) +
          "SELECT n, round(accuracy, 6) AS accuracy, round(weighted_f1, 6) AS weighted_f1 FROM summ")
def a07(spark, sf):
    s = M.summary_metrics(label_pairs_quality(spark, sf))
    return s.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("weighted_f1", 6).alias("weighted_f1"))


def _cm_sql(src: str, classes: list[str]) -> str:
    dim = " UNION ALL ".join(f"SELECT '{c}' AS label, {i} AS class_idx" for i, c in enumerate(classes))
    cols = ", ".join(f"CAST(count(CASE WHEN {src}.p = '{c}' THEN 1 END) AS BIGINT) AS p_{c}" for c in classes)
    return (f"cls AS ({dim}), cm AS (SELECT cls.label, CAST(cls.class_idx AS INTEGER) AS class_idx, {cols} "
            f"FROM cls LEFT JOIN {src} ON {src}.y = cls.label GROUP BY cls.label, cls.class_idx)")


@register("a08_confusion_matrix", _with(_ORD, _cm_sql("o", _CLASSES)) + "SELECT * FROM cm")
def a08(spark, sf):
    return M.confusion_matrix(label_pairs_orders(spark, sf), _CLASSES)


@register("a09_normalized_confusion", _with(_ORD, _cm_sql("o", _CLASSES)) +
          "SELECT label, class_idx, " + ", ".join(
              f"round(CASE WHEN ({' + '.join('p_' + x for x in _CLASSES)}) = 0 THEN NULL ELSE "
              f"p_{c} / ({' + '.join('p_' + x for x in _CLASSES)}) END, 6) AS p_{c}" for c in _CLASSES) + " FROM cm")
def a09(spark, sf):
    n = M.normalized_confusion(M.confusion_matrix(label_pairs_orders(spark, sf), _CLASSES), _CLASSES)
    return n.select("label", "class_idx", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in _CLASSES])


@register("a10_rounded_metrics", _with(_QUAL, _summary_sql("o")) +
          "SELECT round(accuracy, 4) AS accuracy, round(macro_f1, 4) AS macro_f1, round(weighted_f1, 4) AS weighted_f1 FROM summ")
def a10(spark, sf):
    m = M.all_metrics(label_pairs_quality(spark, sf), ["0", "1"], digits=4)
    return m.select("accuracy", "macro_f1", "weighted_f1")


@register("a11_cv_summary", _with(
    _ORD,
    "rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id) AS r FROM o)",
    "off AS (SELECT y, sum(n) OVER (ORDER BY y) - n AS off FROM (SELECT y, count(*) AS n FROM o GROUP BY y))",
    "f AS (SELECT CAST((r - 1 + off) % 5 AS INTEGER) AS fold, CAST(rk.y = rk.p AS DOUBLE) AS ok FROM rk JOIN off USING (y))",
    "sc AS (SELECT fold, avg(ok) AS score FROM f GROUP BY fold)") +
    "SELECT fold, round(score, 6) AS score, round(avg(score) OVER (), 6) AS mean_score, "
    "round(stddev_pop(score) OVER (), 6) AS std_score FROM sc")
def a11(spark, sf):
    pairs = label_pairs_orders(spark, sf)
    folded = S.assign_folds(pairs, k=5, label="y")
    scores = M.accuracy(folded, group=["fold"]).withColumnRenamed("accuracy", "score")
    summ = M.cv_summary(scores)
    # One row per fold with the summary repeated (the summary is one row).
    return (scores.withColumn("_k", F.lit(1)).join(summ.withColumn("_k", F.lit(1)), "_k")
            .select("fold", F.round("score", 6).alias("score"), F.round("mean_score", 6).alias("mean_score"),
                    F.round("std_score", 6).alias("std_score")))


_SRC_PAIRS = ("o AS (SELECT d.source, CAST(l.quality AS VARCHAR) AS y, CAST(l.toxic AS VARCHAR) AS p "
              "FROM labels l JOIN documents d ON l.doc_id = d.doc_id)")


def _source_pairs(spark, sf):
    lab = label_pairs_quality(spark, sf)
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return lab.join(d, "id")


@register("a14_all_metrics", _with(_SRC_PAIRS, _summary_sql("o", "source")) +
          "SELECT source, n, round(accuracy, 4) AS accuracy, round(macro_f1, 4) AS macro_f1, "
          "round(weighted_f1, 4) AS weighted_f1 FROM summ")
def a14(spark, sf):
    m = M.all_metrics(_source_pairs(spark, sf), ["0", "1"], group=["source"])
    s = M.summary_metrics(_source_pairs(spark, sf), group=["source"]).select("source", "n")
    return m.join(s, "source").select("source", "n", "accuracy", "macro_f1", "weighted_f1")


@register("t07_class_metric_rows", _with(_SRC_PAIRS,
          "cls AS (SELECT '0' AS label UNION ALL SELECT '1')",
          "g AS (SELECT DISTINCT source FROM o)",
          "st AS (SELECT g.source, cls.label, "
          "(SELECT count(*) FROM o WHERE o.source = g.source AND o.y = cls.label AND o.p = cls.label) AS tp, "
          "(SELECT count(*) FROM o WHERE o.source = g.source AND o.y = cls.label) AS nt, "
          "(SELECT count(*) FROM o WHERE o.source = g.source AND o.p = cls.label) AS np FROM g, cls)") +
          "SELECT source, label, round(CASE WHEN np = 0 THEN 0 ELSE tp / np END, 4) AS precision, "
          "round(CASE WHEN nt = 0 THEN 0 ELSE tp / nt END, 4) AS rappel, "
          "round(CASE WHEN nt + np = 0 THEN 0 ELSE 2.0 * tp / (nt + np) END, 4) AS f1, CAST(nt AS BIGINT) AS support FROM st")
def t07(spark, sf):
    m = M.all_metrics(_source_pairs(spark, sf), ["0", "1"], group=["source"])
    e = m.select("source", F.explode("par_classe").alias("label", "m"))
    return e.select("source", "label", "m.precision", "m.rappel", "m.f1", "m.support")


# ------------------------------------------------------- probabilities
_EMB_DIM = 64
_EMB_CLASSES = [f"c{i:02d}" for i in range(_EMB_DIM)]  # one class per dimension


def _scores(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))


_SOFTMAX_SQL = ("e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings), "
                "ex AS (SELECT vec_id, list_transform(s, lambda x: exp(x - list_max(s))) AS ex FROM e), "
                "sm AS (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM ex)")


@register("m12_softmax", "WITH " + _SOFTMAX_SQL +
          " SELECT vec_id, round(list_sum(p), 6) AS total, round(list_max(p), 6) AS p_max FROM sm")
def m12(spark, sf):
    p = _scores(spark, sf).select("vec_id", softmax(F.col("s")).alias("p"))
    return p.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                    F.round(F.array_max("p"), 6).alias("p_max"))


_LBL = "['" + "','".join(_EMB_CLASSES) + "']"


@register("t01_ranked_probabilities", "WITH " + _SOFTMAX_SQL +
          f", u AS (SELECT vec_id, unnest(p) AS p, generate_subscripts(p, 1) AS ci FROM sm) "
          f"SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, ci) AS INTEGER) AS rank, "
          f"({_LBL})[ci] AS label, round(p, 6) AS p FROM u")
def t01(spark, sf):
    p = _scores(spark, sf).select("vec_id", softmax(F.col("s")).alias("p"))
    r = p.select("vec_id", F.posexplode(ranked_probabilities(F.col("p"), _EMB_CLASSES)).alias("pos", "e"))
    return r.select("vec_id", (F.col("pos") + 1).cast("int").alias("rank"), "e.label", F.round("e.p", 6).alias("p"))


@register("t02_argmax_label", "WITH " + _SOFTMAX_SQL +
          f" SELECT vec_id, ({_LBL})[list_position(p, list_max(p))] AS label FROM sm")
def t02(spark, sf):
    p = _scores(spark, sf).select("vec_id", softmax(F.col("s")).alias("p"))
    return p.select("vec_id", argmax_label(F.col("p"), _EMB_CLASSES).alias("label"))


# Sixteen voters, four dimensions each; a vote is the class of the largest.
_VOTER_CLASSES = ["batiment", "vehicule", "sinistre", "autre"]
_VOTERS = _EMB_DIM // len(_VOTER_CLASSES)
_VLBL = "['" + "','".join(_VOTER_CLASSES) + "']"


def _voter_sql(i: int) -> str:
    a, b = 4 * i + 1, 4 * i + 4
    return (f"SELECT vec_id, {i} AS voter, ({_VLBL})[list_position(embedding[{a}:{b}], list_max(embedding[{a}:{b}]))] "
            f"AS label FROM embeddings")


@register("m10_hard_vote", "WITH v AS (" + " UNION ALL ".join(_voter_sql(i) for i in range(_VOTERS)) + "), "
          f"c AS (SELECT vec_id, label, count(*) AS n FROM v GROUP BY ALL), "
          f"r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, "
          f"list_position({_VLBL}, label)) AS rk FROM c) SELECT vec_id, label FROM r WHERE rk = 1")
def m10(spark, sf):
    from ..operators.models import hard_vote
    e = read_table(spark, sf, "embeddings")
    ballots = F.array(*[argmax_label(F.slice("embedding", 4 * i + 1, 4), _VOTER_CLASSES) for i in range(_VOTERS)])
    votes = e.select("vec_id", F.posexplode(ballots).alias("voter", "label"))
    return hard_vote(votes, _VOTER_CLASSES, id_col="vec_id")
