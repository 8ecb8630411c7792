"""Run-comparison queries.

The runs are derived from the given tables: one run per ``documents.source``,
evaluating the truth / prediction pairs ``labels.quality`` vs ``labels.toxic``
of that source's documents, so the run table grows with the data. Each run
is a ``RUN_SCHEMA`` row (nested ``data`` / ``test_metrics``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import display_timestamp
from ..operators import metrics as M
from .adapters import read_table
from .registry import register

CLASSES = ["0", "1"]


def runs_from_tables(spark, sf) -> DataFrame:
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    lab = read_table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("y"),
        F.col("toxic").cast("string").alias("p"))
    pairs = lab.join(d, "id")
    met = M.all_metrics(pairs, CLASSES, group=["source"])
    dist = (pairs.groupBy("source", "y").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("dist")))
    sizes = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id"))
    n_lab = pairs.groupBy("source").agg(F.count(F.lit(1)).alias("n_test"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("first_id") % 365).cast("int"))
    j = sizes.join(n_lab, "source").join(dist, "source").join(met, "source")
    return j.select(
        F.concat("source", F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit("_000000")).alias("experiment_id"),
        F.col("source").alias("experiment_name"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00.000000")).alias("timestamp"),
        (F.col("n_docs") / 100.0).alias("duration_seconds"),
        F.lit("terminee").alias("status"),
        F.struct((F.col("n_docs") - F.col("n_test")).alias("n_train"), F.lit(0).cast("long").alias("n_val"),
                 F.col("n_test").cast("long").alias("n_test"), F.col("n_docs").cast("long").alias("n_total"),
                 F.col("dist").alias("distribution_classes")).alias("data"),
        F.lit(None).cast("struct<mean_accuracy:double,std_accuracy:double,fold_scores:array<double>>")
        .alias("cv_results"),
        F.struct("accuracy", "macro_f1", "weighted_f1", "par_classe").alias("test_metrics"),
        F.concat(F.lit("runs/"), F.col("source"), F.lit("_"), F.date_format(day, "yyyyMMdd"),
                 F.lit("_000000")).alias("_path"),
    )


def flatten_runs(runs: DataFrame) -> DataFrame:
    """nested record -> flat columns (missing -> NULL)."""
    return runs.select(
        "experiment_id", "experiment_name",
        display_timestamp("timestamp").alias("shown_time"),
        F.col("test_metrics.accuracy").alias("accuracy"),
        F.col("test_metrics.macro_f1").alias("macro_f1"),
        F.col("test_metrics.weighted_f1").alias("weighted_f1"),
        F.col("cv_results.mean_accuracy").alias("cv_mean"),
        F.col("data.n_total").alias("n_total"),
        "duration_seconds", "_path")


# ------------------------------------------------------------ SQL twin
_RUN_SQL = """WITH pairs AS (SELECT d.source, CAST(l.quality AS VARCHAR) AS y, CAST(l.toxic AS VARCHAR) AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
lab AS (SELECT source, y AS label, 1 AS t, 0 AS pr, CAST(y = p AS INT) AS tp FROM pairs
  UNION ALL SELECT source, p, 0, 1, 0 FROM pairs),
ls AS (SELECT source, label, sum(tp) AS tp, sum(t) AS nt, sum(pr) AS np FROM lab GROUP BY ALL),
lf AS (SELECT *, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS precision,
  CASE WHEN nt = 0 THEN 0 ELSE tp / nt END AS rappel,
  CASE WHEN nt + np = 0 THEN 0 ELSE 2.0 * tp / (nt + np) END AS f1 FROM ls),
cls AS (SELECT source, c.label, round(coalesce(lf.precision, 0), 4) AS precision, round(coalesce(lf.rappel, 0), 4) AS rappel,
  round(coalesce(lf.f1, 0), 4) AS f1, CAST(coalesce(lf.nt, 0) AS BIGINT) AS support
  FROM (SELECT DISTINCT source FROM pairs) s CROSS JOIN (SELECT '0' AS label UNION ALL SELECT '1') c
  LEFT JOIN lf USING (source, label)),
summ AS (SELECT source, round(sum(tp) / sum(nt), 4) AS accuracy, round(avg(f1), 4) AS macro_f1,
  round(sum(f1 * nt) / sum(nt), 4) AS weighted_f1 FROM lf GROUP BY source),
sz AS (SELECT source, count(*) AS n_docs, min(doc_id) AS first_id FROM documents GROUP BY source),
runs AS (SELECT source || '_' || strftime(DATE '2024-01-01' + CAST(first_id % 365 AS INTEGER), '%Y%m%d') || '_000000' AS experiment_id,
  source AS experiment_name,
  strftime(DATE '2024-01-01' + CAST(first_id % 365 AS INTEGER), '%Y-%m-%d') || 'T00:00:00.000000' AS timestamp,
  n_docs / 100.0 AS duration_seconds, accuracy, macro_f1, weighted_f1, CAST(NULL AS DOUBLE) AS cv_mean,
  CAST(n_docs AS BIGINT) AS n_total,
  'runs/' || source || '_' || strftime(DATE '2024-01-01' + CAST(first_id % 365 AS INTEGER), '%Y%m%d') || '_000000' AS _path
  FROM sz JOIN summ USING (source)),
rc AS (SELECT r.experiment_id, c.label, c.precision, c.rappel, c.f1, c.support FROM cls c JOIN runs r ON r.experiment_name = c.source)
"""


@register("f13_flatten_record", _RUN_SQL +
          "SELECT experiment_id, experiment_name, replace(substring(timestamp, 1, 19), 'T', ' ') AS shown_time, "
          "accuracy, macro_f1, weighted_f1, cv_mean, n_total, duration_seconds, _path FROM runs")
def f13(spark, sf):
    return flatten_runs(runs_from_tables(spark, sf))


@register("t03_runs_by_path", _RUN_SQL +
          "SELECT experiment_id, _path, CAST(row_number() OVER (ORDER BY _path DESC) AS INTEGER) AS pos FROM runs")
def t03(spark, sf):
    from ..operators.ranking import ordered_index
    r = runs_from_tables(spark, sf).select("experiment_id", "_path")
    return ordered_index(r, [F.desc("_path")], "i").select("experiment_id", "_path", (F.col("i") + 1).cast("int").alias("pos"))


@register("t04_sort_by_accuracy", _RUN_SQL +
          "SELECT experiment_id, accuracy, CAST(row_number() OVER (ORDER BY accuracy, experiment_id) AS INTEGER) AS pos "
          "FROM runs WHERE accuracy IS NOT NULL")
def t04(spark, sf):
    from ..operators.ranking import ordered_index
    r = flatten_runs(runs_from_tables(spark, sf)).na.drop(subset=["accuracy"]).select("experiment_id", "accuracy")
    return ordered_index(r, [F.col("accuracy"), F.col("experiment_id")], "i").select(
        "experiment_id", "accuracy", (F.col("i") + 1).cast("int").alias("pos"))


@register("t05_default_selection", _RUN_SQL + "SELECT experiment_id FROM runs ORDER BY _path DESC LIMIT 4")
def t05(spark, sf):
    # A top-4 selection is the feature here (default runs shown).
    return runs_from_tables(spark, sf).orderBy(F.desc("_path")).limit(4).select("experiment_id")


@register("t06_unpivot_class_metrics", _RUN_SQL +
          "SELECT experiment_id, label, metric, value FROM rc UNPIVOT (value FOR metric IN (precision, rappel, f1))")
def t06(spark, sf):
    r = runs_from_tables(spark, sf)
    rows = r.select("experiment_id", F.explode("test_metrics.par_classe").alias("label", "m"))
    flat = rows.select("experiment_id", "label", "m.precision", "m.rappel", "m.f1")
    return flat.unpivot(["experiment_id", "label"], ["precision", "rappel", "f1"], "metric", "value")


@register("t08_runs_class_f1_grid", _RUN_SQL +
          "SELECT experiment_id, max(CASE WHEN label = '0' THEN f1 END) AS f1_0, "
          "max(CASE WHEN label = '1' THEN f1 END) AS f1_1 FROM rc GROUP BY experiment_id")
def t08(spark, sf):
    r = runs_from_tables(spark, sf)
    rows = r.select("experiment_id", F.explode("test_metrics.par_classe").alias("label", "m"))
    # Classes = distinct union over runs (W09); pivot leaves NULL where a run lacks a class.
    classes = [x.label for x in class_union(r).collect()]  # bounded: one row per class
    g = rows.groupBy("experiment_id").pivot("label", classes).agg(F.first("m.f1"))
    return g.select("experiment_id", *[F.col(f"`{c}`").alias(f"f1_{c}") for c in classes])


def class_union(runs: DataFrame) -> DataFrame:
    """Distinct class names over all runs, sorted."""
    return (runs.select(F.explode(F.map_keys("test_metrics.par_classe")).alias("label"))
            .distinct().orderBy("label"))


@register("w09_class_union", _RUN_SQL + "SELECT DISTINCT label FROM rc")
def w09(spark, sf):
    return class_union(runs_from_tables(spark, sf))


@register("t09_compare_runs", _RUN_SQL +
          "SELECT experiment_id, metric, value FROM (SELECT experiment_id, accuracy, macro_f1, weighted_f1, cv_mean FROM runs) "
          "UNPIVOT INCLUDE NULLS (value FOR metric IN (accuracy, macro_f1, weighted_f1, cv_mean))")
def t09(spark, sf):
    f = flatten_runs(runs_from_tables(spark, sf))
    return f.unpivot(["experiment_id"], ["accuracy", "macro_f1", "weighted_f1", "cv_mean"], "metric", "value")


@register("w10_run_lookup", _RUN_SQL + "SELECT experiment_id, accuracy FROM runs WHERE experiment_name = 'src3' "
          "ORDER BY _path DESC LIMIT 1")
def w10(spark, sf):
    f = flatten_runs(runs_from_tables(spark, sf))
    return f.where(F.col("experiment_name") == "src3").orderBy(F.desc("_path")).limit(1).select("experiment_id", "accuracy")


_METRICS = ["accuracy", "macro_f1", "weighted_f1", "cv_mean"]


def nonempty_metrics(flat: DataFrame, metrics=_METRICS) -> list[str]:
    """Metrics with at least one non-null value (one tiny aggregate row)."""
    row = flat.agg(*[(F.count(m) > 0).alias(m) for m in metrics]).first()
    return [m for m in metrics if row[m]]


@register("w11_nonempty_metrics", _RUN_SQL + "SELECT experiment_id, accuracy, macro_f1, weighted_f1 FROM runs")
def w11(spark, sf):
    f = flatten_runs(runs_from_tables(spark, sf))
    return f.select("experiment_id", *nonempty_metrics(f))


@register("a13_run_summary", _RUN_SQL +
          "SELECT (SELECT count(*) FROM runs) AS n_runs, max(accuracy) AS best_accuracy, "
          "(SELECT experiment_id FROM runs WHERE accuracy IS NOT NULL ORDER BY accuracy DESC, experiment_id LIMIT 1) "
          "AS best_run FROM runs")
def a13(spark, sf):
    f = flatten_runs(runs_from_tables(spark, sf))
    best = F.min_by("experiment_id", F.struct(-F.col("accuracy"), F.col("experiment_id")))
    return f.agg(F.count(F.lit(1)).alias("n_runs"), F.max("accuracy").alias("best_accuracy"),
                 F.when(F.count("accuracy") > 0, best).alias("best_run"))


@register("j06_compare_runs", _RUN_SQL +
          "SELECT experiment_id, accuracy, macro_f1, weighted_f1, "
          "CAST(rank() OVER (ORDER BY accuracy DESC) AS INTEGER) AS acc_rank, "
          "accuracy = max(accuracy) OVER () AS is_best FROM runs")
def j06(spark, sf):
    from ..operators.ranking import ordered_index
    f = flatten_runs(runs_from_tables(spark, sf)).select("experiment_id", "accuracy", "macro_f1", "weighted_f1")
    # Rank of a tie = place of its first row; accuracies repeat, so the first
    # places are one row per value.
    placed = ordered_index(f, [F.desc("accuracy")], "i")
    firsts = placed.groupBy("accuracy").agg((F.min("i") + 1).cast("int").alias("acc_rank"))
    best = f.agg(F.max("accuracy").alias("best")).select("best").scalar()
    p, q = placed.alias("p"), firsts.alias("q")
    return p.join(q, F.col("p.accuracy").eqNullSafe(F.col("q.accuracy"))).select(
        "experiment_id", "p.accuracy", "macro_f1", "weighted_f1", "acc_rank", (F.col("p.accuracy") == best).alias("is_best"))
