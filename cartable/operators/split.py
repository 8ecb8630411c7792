"""Exact, reproducible splits and folds.

Rows are ordered inside their class by ``md5(id || '-' || seed)`` (ties by id).
Per-class quotas follow the stratified shuffle split rule: the train+val part
gets ``n - ceil(test_size * n)`` rows, shared among classes by floor plus
largest remainder (ties by label); the test part per class is the rest. The
same rule splits train+val into train and val.

Ranks are computed with ``bucketed_rank`` so a class that holds a third of the
rows is still ranked by many tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import bucketed_rank

# Target rows per rank bucket; the number of md5 hex digits used to bucket
# rows is derived so that the largest class stays near this size per bucket.
ROWS_PER_BUCKET = 1_000_000
MD5_DIGITS = 32
SPLITS = ("train", "val", "test")


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{int(seed)}")))


def _largest_remainder(counts: DataFrame, n_col: str, draws: Column, out: str, label: str) -> DataFrame:
    """Share ``draws`` among classes in proportion to ``n_col``: floor, then one
    more for the largest remainders (ties by label). ``counts`` is the small
    per-class table."""
    total = F.sum(n_col).over(Window.partitionBy())
    # Nothing to share (e.g. every row went to the test part): all zero.
    cont = F.when(total > 0, (F.col(n_col) / total) * draws).otherwise(F.lit(0.0))
    df = counts.withColumn("_cont", cont).withColumn("_fl", F.floor("_cont"))
    need = draws - F.sum("_fl").over(Window.partitionBy())
    rk = F.row_number().over(Window.orderBy(F.desc(F.col("_cont") - F.col("_fl")), F.col(label)))
    return (df.withColumn(out, (F.col("_fl") + F.when(rk <= need, 1).otherwise(0)).cast("long"))
            .drop("_cont", "_fl"))


def split_quotas(df: DataFrame, label: str = "label", test_size: float = 0.2, val_size: float = 0.1,
                 stratify: bool = True) -> DataFrame:
    """``(label, n, n_train, n_val, n_test)``; one row per class.

    Works on the class-count table only (one row per class), so the windows
    here never see the data rows.
    """
    key = F.col(label) if stratify else F.lit("__all__")
    counts = df.groupBy(key.alias(label)).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    n_test_total = F.ceil(F.lit(float(test_size)) * total)
    counts = counts.withColumn("_draws_tv", total - n_test_total)
    q = _largest_remainder(counts, "n", F.col("_draws_tv"), "n_tv", label)
    q = q.withColumn("n_test", F.col("n") - F.col("n_tv"))
    rel = float(val_size) / (1.0 - float(test_size))
    tv_total = F.sum("n_tv").over(Window.partitionBy())
    q = q.withColumn("_draws_tr", tv_total - F.ceil(F.lit(rel) * tv_total))
    q = _largest_remainder(q, "n_tv", F.col("_draws_tr"), "n_train", label)
    q = q.withColumn("n_val", F.col("n_tv") - F.col("n_train"))
    return q.select(label, "n", "n_train", "n_val", "n_test")


def bucket_digits(largest_group: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex digits so that ``largest_group / 16**digits <= rows_per_bucket``."""
    d = 1
    while d < MD5_DIGITS and largest_group / (16 ** d) > rows_per_bucket:
        d += 1
    return d


def _largest_group(df: DataFrame, keys: list[str]) -> int:
    # One row per class (or one row): a bounded result on the driver.
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    return int(g.agg(F.max("n")).first()[0] or 0)


def _ranked(df: DataFrame, keys: list[str], id_col: str, seed: int, digits: int | None = None) -> DataFrame:
    """Exact rank inside ``keys`` by the md5 order key, computed per
    ``(keys, md5 prefix)`` bucket (see ``ranking.bucketed_rank``)."""
    digits = digits or bucket_digits(_largest_group(df, keys))
    keyed = df.withColumn("_h", order_key(id_col, seed))
    return bucketed_rank(keyed, keys, "_h", id_col, F.substring("_h", 1, digits), "_rank").drop("_h")


def assign_split(df: DataFrame, label: str = "label", id_col: str = "id", test_size: float = 0.2,
                 val_size: float = 0.1, stratify: bool = True, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """Adds ``split`` in {train, val, test}; disjoint and exhaustive."""
    quotas = split_quotas(df, label, test_size, val_size, stratify)
    if stratify:
        ranked = _ranked(df, [label], id_col, seed)
        # One row per class; AQE broadcasts it from its measured size.
        q = quotas.select(label, "n_test", "n_val")
        j = ranked.join(q, label)
    else:
        ranked = _ranked(df, [], id_col, seed).withColumn("_all", F.lit("__all__"))
        q = F.broadcast(quotas.select(F.col(label).alias("_all"), "n_test", "n_val"))  # exactly one row
        j = ranked.join(q, "_all").drop("_all")
    s = (F.when(F.col("_rank") <= F.col("n_test"), "test")
         .when(F.col("_rank") <= F.col("n_test") + F.col("n_val"), "val").otherwise("train"))
    return j.withColumn(out, s).drop("_rank", "n_test", "n_val")


def split_frames(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = assign_split(df, **kw)
    return tuple(s.where(F.col("split") == name).drop("split") for name in SPLITS)


def assign_folds(df: DataFrame, k: int = 5, label: str = "label", id_col: str = "id",
                 seed: int = 42, stratify: bool = True, out: str = "fold") -> DataFrame:
    """``fold`` in [0, k); per class the fold sizes differ by at most one.

    ``fold = (rank in class - 1 + rows of earlier classes) % k``.
    """
    if not stratify:
        r = _ranked(df, [], id_col, seed)
        return r.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")
    r = _ranked(df, [label], id_col, seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.withColumn("_off", F.sum("_n").over(Window.orderBy(label)) - F.col("_n")).drop("_n")
    return (r.join(offs, label)
            .withColumn(out, ((F.col("_rank") - 1 + F.col("_off")) % k).cast("int"))
            .drop("_rank", "_off"))


def fold_train(folded: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    """Training rows of a fold (all rows not in it)."""
    return folded.where(F.col(fold_col) != fold)


def fold_valid(folded: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    return folded.where(F.col(fold_col) == fold)


def union_train_val(train: DataFrame, val: DataFrame) -> DataFrame:
    """Bag union."""
    return train.unionByName(val)
