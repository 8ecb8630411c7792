"""TF-IDF as aggregations and joins.

Long form ``(id, term, tf)`` is the source of truth; sparse vectors are built
only at the model boundary (V12).

Partitioning: ``term_counts`` hash-partitions the documents by id once and counts
terms inside the document's row. The vocabulary join (broadcast, bounded by
``max_features``) and the per-document L2 norm window reuse that partitioning, so
the long form is never shuffled. The only
other exchange is the document-frequency aggregate, which is partially
aggregated on the map side (a hot term costs one row per partition).
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import WS_CLASS
from ..functions.terms import (ACCENT_MODES, char_ngram_windows, char_wb_ngrams, normalize_for_char_ngrams, strip_accents,
                               whitespace_words, word_ngrams, word_tokens)
from ..session import ship

ANALYZERS = ("word", "char_wb", "char")
# A vocabulary with at most this many terms is broadcast to the long form.
BROADCAST_VOCAB_MAX = 2_000_000
# One with at most this many is shipped to the tasks that count known terms.
SHIPPED_VOCAB_MAX = 200_000
HELD_TERMS = 400_000    # distinct terms whose partial statistics a task holds, about 200 bytes each
CELLS_PER_BATCH = 200_000


@dataclass(frozen=True)
class TfidfParams:
    max_features: int | None = 15000
    ngram_range: tuple = (1, 2)
    sublinear_tf: bool = True
    min_df: float = 2
    max_df: float = 1.0
    analyzer: str = "word"
    lowercase: bool = True
    strip_accents: str | None = None

    @staticmethod
    def from_dict(d: dict | None) -> "TfidfParams":
        d = dict(d or {})
        p = TfidfParams(
            max_features=d.get("max_features", 15000),
            ngram_range=tuple(d.get("ngram_range", (1, 2))),
            sublinear_tf=d.get("sublinear_tf", True),
            min_df=d.get("min_df", 2),
            max_df=d.get("max_df", 1.0),
            analyzer=d.get("analyzer", "word"),
            lowercase=d.get("lowercase", True),
            strip_accents=d.get("strip_accents", None),
        )
        if p.strip_accents is not None and p.strip_accents not in ACCENT_MODES:
            raise ValueError(f"unknown accent mode {p.strip_accents!r}; expected one of {ACCENT_MODES}")
        if p.analyzer not in ANALYZERS:
            raise ValueError(f"unknown analyzer {p.analyzer!r}; expected one of {ANALYZERS}")
        return p

    def with_(self, **kw) -> "TfidfParams":
        return replace(self, **kw)


def analyze_stages(p: TfidfParams):
    """Split the analyzer into (pre, post) column functions.

    ``pre`` runs once per document (lower-casing, accent stripping, regex
    tokenisation); ``post`` builds the n-grams from a *column reference* to
    ``pre``'s output. Keeping them in two projections matters: a lambda that
    refers to an expression re-evaluates it for every array element, which is
    quadratic in the text length; a column reference is evaluated once.
    """
    def base(text: Column) -> Column:
        t = F.lower(text) if p.lowercase else text
        return strip_accents(t, p.strip_accents) if p.strip_accents else t

    lo, hi = p.ngram_range
    if p.analyzer == "word":
        return (lambda text: word_tokens(base(text), lowercase=False),
                lambda tok: word_ngrams(tok, lo, hi))
    if p.analyzer == "char_wb":
        return base, lambda t: char_wb_ngrams(t, lo, hi, lowercase=False)
    return (lambda text: normalize_for_char_ngrams(base(text), lowercase=False),
            lambda t: char_ngram_windows(t, lo, hi))


def partition_docs(docs: DataFrame, id_col: str = "id", num_partitions: int | None = None) -> DataFrame:
    """Hash-partition documents by id (a group is one id, so no skew).

    The number is given, by default the session's: without one, adaptive execution
    merges partitions to about ``input / cores``, and a task's share grows with the input."""
    n = num_partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(n, id_col)


def _merged_by_id(staged: DataFrame, keys: list[str]) -> DataFrame:
    """One row per id: ``_pre`` becomes the list of the id's analysed texts (one,
    unless the id repeats). A window over the partitioned documents sorts document
    rows, never occurrences."""
    by_id = Window.partitionBy(*keys)
    rows = staged.select(*keys, F.row_number().over(by_id.orderBy("_pre")).alias("_n"),
                         F.collect_list("_pre").over(by_id).alias("_pre"))
    return rows.where(F.col("_n") == 1).drop("_n")


def _run_bounds(s: Column) -> Column:
    """Where the runs of equal values of a sorted array begin, then its size; an empty
    array has one run of length 0."""
    # Below two values the sequence counts down to positions whose comparison is null.
    inner = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) != F.get(s, i - 1))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.size(s)))


def _runs(s: Column, at: Column) -> Column:
    """``array<struct<term, tf>>`` of a sorted array and its ``_run_bounds``."""
    return F.transform(F.slice(at, 1, F.size(at) - 1), lambda p, j: F.struct(
        F.get(s, p).alias("term"), (F.get(at, j + 1) - p).alias("tf")))


def term_counts(docs: DataFrame, params: TfidfParams, text_col: str = "text",
                id_col: str = "id", carry: list[str] | tuple = (),
                partitioned: bool = False) -> DataFrame:
    """``(id, *carry, term, tf)``; ``carry`` columns depend on id only.

    A document's terms are sorted and counted inside its row, so neither memory nor
    spill follows the number of occurrences in a partition."""
    src = docs if partitioned else partition_docs(docs.select(id_col, text_col, *carry), id_col)
    keys = [id_col, *carry]
    pre, post = analyze_stages(params)
    merged = _merged_by_id(src.select(*keys, pre(F.col(text_col)).alias("_pre")), keys)
    # One projection per stage: lambdas read columns, not expressions.
    terms = merged.select(*keys, F.sort_array(F.flatten(F.transform("_pre", post))).alias("_s"))
    bounds = terms.select(*keys, "_s", _run_bounds(F.col("_s")).alias("_at"))
    runs = bounds.select(*keys, F.inline(_runs(F.col("_s"), F.col("_at"))))
    # Filtered here: a filter on the sorted array would be pushed below it and sort twice.
    return runs.where(F.col("tf") > 0).select(*keys, "term", F.col("tf").cast("long").alias("tf"))


# ------------------------------------------- counting inside tasks (training)
def counted_in_tasks(p: TfidfParams) -> bool:
    """Whether ``grams_of`` knows the analyzer."""
    return p.analyzer in ("word", "char_wb")


def staged_texts(docs: DataFrame, p: TfidfParams, text_col: str = "text", id_col: str = "id", carry: list[str] | tuple = ()) -> DataFrame:
    """``(id, *carry, _text)``, one row per id, partitioned by id: the tokens (words of
    ``char_wb``) joined by a space, and the texts of an id that repeats by a line feed;
    tokens and words hold neither."""
    def base(text: Column) -> Column:
        t = F.lower(text) if p.lowercase else text
        return strip_accents(t, p.strip_accents) if p.strip_accents else t

    src = partition_docs(docs.select(id_col, text_col, *carry), id_col)
    keys = [id_col, *carry]
    t = base(F.col(text_col))
    parts = word_tokens(t, lowercase=False) if p.analyzer == "word" else whitespace_words(t)
    merged = _merged_by_id(src.select(*keys, F.array_join(parts, " ").alias("_pre")), keys)
    return merged.select(*keys, F.array_join("_pre", "\n").alias("_text"))


def grams_of(p: TfidfParams) -> Callable[[str], dict]:
    """Term -> occurrences of a staged text, the terms of ``term_counts``."""
    lo, hi = (int(n) for n in p.ngram_range)
    if p.analyzer == "word":
        def count(text: str) -> dict:
            grams: list = []
            for line in text.split("\n"):
                tok = line.split(" ") if line else []
                for n in range(lo, hi + 1):
                    grams += tok if n == 1 else [f"{a} {b}" for a, b in zip(tok, tok[1:])] if n == 2 else map(
                        " ".join, zip(*[tok[i:] for i in range(n)]))
            return Counter(grams)
        return count

    known: dict = {}

    def grams(word: str) -> list:
        if word not in known:
            if len(known) >= 20_000:
                known.clear()
            w = f" {word} "
            known[word] = [g for n in range(lo, hi + 1) for g in (
                [w[i:i + n] for i in range(len(w) - n + 1)] if len(w) > n else [w] if max(lo, len(w)) == n else [])]
        return known[word]

    def count_chars(text: str) -> dict:
        out: dict = {}
        get = out.get
        for word, times in Counter(w for line in text.split("\n") if line for w in line.split(" ")).items():
            for g in grams(word):
                out[g] = get(g, 0) + times
        return out
    return count_chars


_ONE = 1 << 40  # one document in the sums of ``partial_statistics``; occurrences are below it


def partial_statistics(staged: DataFrame, p: TfidfParams, part: str | None = None) -> DataFrame:
    """Partial ``(term, df, cf)``, or ``(part, term, df, cf)`` by the values of a carried
    column. A task adds up its documents' counts and emits sums, never occurrences."""
    ship(staged.sparkSession)

    def work(batches):
        count, held, size = grams_of(p), {}, 0

        def emit():
            for k, sums in held.items():
                terms, both = list(sums), np.fromiter(sums.values(), np.int64, len(sums))
                for i in range(0, len(terms), CELLS_PER_BATCH):
                    b = both[i:i + CELLS_PER_BATCH]
                    cols = [pa.array(terms[i:i + CELLS_PER_BATCH], pa.string()), pa.array(b >> 40), pa.array(b & (_ONE - 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(b), pa.int32()), *cols][part is None:], names)
            held.clear()

        names = ["part", "term", "df", "cf"][part is None:]
        for batch in batches:
            texts, parts = batch.column("_text"), batch.column(part).to_pylist() if part else None
            for i in range(batch.num_rows):
                sums = held.setdefault(parts[i] if parts else None, {})
                before, get = len(sums), sums.get
                for term, n in count(texts[i].as_py()).items():
                    sums[term] = get(term, 0) + n + _ONE
                size += len(sums) - before
                if size > HELD_TERMS:
                    yield from emit()
                    size = 0
        yield from emit()

    head = f"{part} int, " if part else ""
    return staged.select(*[part] * bool(part), "_text").mapInArrow(work, f"{head}term string, df long, cf long")


def term_statistics(staged: DataFrame, p: TfidfParams) -> DataFrame:
    """``(term, df, cf)`` of staged texts."""
    return partial_statistics(staged, p).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def statistics_outside(staged: DataFrame, p: TfidfParams, part: str, parts: int) -> DataFrame:
    """``(term, df_0, cf_0, ...)``: statistics outside each part, from one pass. Terms too
    rare over all parts are rare outside any one."""
    sums = partial_statistics(staged, p, part)
    inside = lambda c, i: F.coalesce(F.sum(F.when(F.col(part) == i, F.col(c))), F.lit(0))
    wide = sums.groupBy("term").agg(F.sum("df").alias("df"), *[(F.sum(c) - inside(c, i)).alias(f"{c}_{i}") for i in range(parts) for c in ("df", "cf")])
    return (wide.where(F.col("df") >= p.min_df) if isinstance(p.min_df, int) else wide).drop("df")


_CELLS = "array<struct<idx:int,tf:bigint,idf:double>>"


def _cells(ends, idx, tf, idf) -> pa.ListArray:
    cols = [pa.array(idx, pa.int32()), pa.array(tf, pa.int64()), pa.array(idf, pa.float64())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, ["idx", "tf", "idf"]))


def known_counts(staged: DataFrame, p: TfidfParams, terms: list[str], keys: list[str], idf: np.ndarray | None = None) -> DataFrame:
    """``(*keys, cells)``: per id the places in ``terms`` (ascending) of the terms a text
    holds, their occurrences and ``idf`` (0 if not given)."""
    ship(staged.sparkSession)
    place, weights = {t: i for i, t in enumerate(terms)}, np.zeros(len(terms)) if idf is None else idf

    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = grams_of(p)
        for column in texts:
            idx, tf, ends = [], [], [0]
            for i in range(len(column)):
                found = sorted((place[t], n) for t, n in count(column[i].as_py()).items() if t in place)
                idx += [j for j, _ in found]
                tf += [n for _, n in found]
                ends.append(len(idx))
                if len(idx) >= CELLS_PER_BATCH or i + 1 == len(column):
                    yield _cells(ends, idx, tf, weights[np.array(idx, np.int64)])
                    idx, tf, ends = [], [], [0]

    return staged.select(*keys, F.arrow_udf(work, _CELLS)("_text").alias("cells"))


def cells_of_vocabulary(counts: DataFrame, idx: np.ndarray, idf: np.ndarray, keys: list[str]) -> DataFrame:
    """``known_counts`` with other places: place i becomes ``idx[i]`` (ascending too), or goes if that is below 0."""
    def work(cells: pa.Array) -> pa.Array:
        offsets, flat = cells.offsets.to_numpy(), cells.values
        low = offsets[0]
        at = flat.field("idx").to_numpy()[low:offsets[-1]]
        keep = idx[at] >= 0
        ends = np.r_[0, np.cumsum(keep)][offsets - low]
        return _cells(ends, idx[at[keep]], flat.field("tf").to_numpy()[low:offsets[-1]][keep], idf[at[keep]])

    return counts.select(*keys, F.arrow_udf(work, _CELLS)("cells").alias("cells"))


def weighted_long(known: DataFrame, p: TfidfParams, id_col: str = "id", offset: int = 0) -> DataFrame:
    """``(id, idx, weight)`` of ``known_counts``, the weights of ``transform_counts``. A
    document's weights are made inside its row; ``sparse_rows`` and ``feature_lists``
    take the rows as they are (``_lists``), so cells are not gathered again."""
    w = F.transform("cells", lambda c: F.struct((c["idx"] + F.lit(offset)).alias("i"), (tf_weight(c["tf"], p.sublinear_tf) * c["idf"]).alias("w")))
    rows = known.select(id_col, w.alias("_e"))
    rows = rows.select(id_col, "_e", F.sqrt(F.aggregate("_e", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])).alias("_norm"))
    # The norm is read twice, so that it stays a column and is not worked out for every cell.
    v = F.when(F.col("_norm") > 0, F.transform("_e", lambda x: x["w"] / F.col("_norm"))).otherwise(F.transform("_e", lambda x: x["w"]))
    lists = rows.select(id_col, F.col("_e.i").alias("f"), v.alias("v"))
    long = lists.select(id_col, F.inline(F.arrays_zip(F.col("f").alias("idx"), F.col("v").alias("weight"))))
    long._lists = lists
    return long


def _doc_count_threshold(v, n_docs: Column) -> Column:
    # int -> document count, float -> proportion of documents.
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise ValueError(f"min_df / max_df must be a number, got {v!r}")
    return F.lit(v) if isinstance(v, int) else F.lit(float(v)) * n_docs


def document_frequencies(counts: DataFrame, params: TfidfParams, n_docs: Column,
                         id_col: str = "id") -> DataFrame:
    """``(term, df, cf)`` filtered by ``min_df`` / ``max_df``."""
    return frequent_terms(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), params, n_docs)


def frequent_terms(stats: DataFrame, params: TfidfParams, n_docs: Column) -> DataFrame:
    lo = _doc_count_threshold(params.min_df, n_docs)
    hi = _doc_count_threshold(params.max_df, n_docs)
    return stats.where((F.col("df") >= lo) & (F.col("df") <= hi))


def fit_vocabulary(counts: DataFrame | None, n_docs: int | Column, params: TfidfParams,
                   id_col: str = "id", stats: DataFrame | None = None, exact_cut: bool = True) -> DataFrame:
    """Fitted vocabulary ``(term, idx, df, cf, idf)``.

    ``max_features`` keeps the terms with the largest corpus frequency (ties by
    term); positions are alphabetical. ``idf = ln((1+n)/(1+df)) + 1``.

    Without ``stats`` the cap is a distributed ``orderBy().limit(k)``: one lazy
    plan in which the text exchange is reused, but the last step merges up to
    ``partitions x k`` candidates in one task. With ``stats`` (the persisted
    term statistics, see ``fit_tfidf``) the cap is an exact cut through a
    frequency histogram, so no task receives more than its share (``exact_cut``
    off: the plain limit on them, fewer jobs for the many vocabularies of folds).
    """
    n = F.lit(n_docs) if not isinstance(n_docs, Column) else n_docs
    kept = stats if stats is not None else document_frequencies(counts, params, n, id_col)
    if params.max_features is not None:
        if stats is not None and exact_cut:
            from .ranking import top_k_exact
            kept = top_k_exact(kept, int(params.max_features), "cf", "term")
        else:
            kept = kept.orderBy(F.desc("cf"), F.asc("term")).limit(int(params.max_features))
        # The k kept terms (bounded) are numbered alphabetically.
        vocab = kept.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)
    else:
        from .ranking import global_index
        vocab = global_index(kept, ["term"], "idx")
    return vocab.withColumn("idf", idf_value(n, F.col("df"))).select("term", "idx", "df", "cf", "idf")


def tf_weight(tf: Column, sublinear: bool) -> Column:
    """V05."""
    return (F.lit(1.0) + F.log(tf)) if sublinear else tf.cast("double")


def idf_value(n_docs: Column, df: Column) -> Column:
    """Smoothed IDF."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def transform_counts(counts: DataFrame, vocab: DataFrame, params: TfidfParams,
                     id_col: str = "id", carry: list[str] | tuple = (),
                     offset: int = 0, normalize: bool = True) -> DataFrame:
    """Long-form TF-IDF ``(id, *carry, term, idx, weight)``.

    Unseen terms are dropped by the inner join; a document left without terms
    has no rows (it is an all-zero vector).
    """
    bounded = params.max_features is not None and params.max_features <= BROADCAST_VOCAB_MAX
    v = vocab.select("term", "idx", "idf")
    v = F.broadcast(v) if bounded else v
    j = counts.join(v, "term")
    w = tf_weight(F.col("tf"), params.sublinear_tf) * F.col("idf")
    j = j.withColumn("w", w)
    if normalize:
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
        j = j.withColumn("w", F.col("w") / norm)
    return j.select(id_col, *carry, "term", (F.col("idx") + F.lit(offset)).alias("idx"),
                    F.col("w").alias("weight"))


@dataclass
class TfidfModel:
    """A fitted vocabulary plus the parameters that produced it."""
    params: TfidfParams
    vocab: DataFrame
    n_docs: int
    size: int
    text_col: str = "text"
    id_col: str = "id"
    _terms: tuple | None = field(default=None, repr=False, compare=False)

    def counts(self, docs: DataFrame, carry=(), partitioned: bool = False) -> DataFrame:
        return term_counts(docs, self.params, self.text_col, self.id_col, carry, partitioned)

    def transform(self, docs: DataFrame, carry=(), offset: int = 0, partitioned: bool = False) -> DataFrame:
        return transform_counts(self.counts(docs, carry, partitioned), self.vocab, self.params,
                                self.id_col, carry, offset)

    def features(self, docs: DataFrame, offset: int = 0) -> DataFrame:
        """``(id, idx, weight)`` of ``transform``. A vocabulary that is small by count goes
        to the tasks, which count its terms only, so no other term becomes a row."""
        if self.size > SHIPPED_VOCAB_MAX or not counted_in_tasks(self.params):
            return self.transform(docs, offset=offset).select(self.id_col, F.col("idx").cast("int").alias("idx"), "weight")
        if self._terms is None:
            rows = self.vocab.select("idx", "term", "idf").orderBy("idx").collect()  # bounded: size
            self._terms = [r["term"] for r in rows], np.array([r["idf"] for r in rows], float)
        staged = staged_texts(docs, self.params, self.text_col, self.id_col)
        return weighted_long(known_counts(staged, self.params, self._terms[0], [self.id_col], self._terms[1]), self.params, self.id_col, offset)


class EmptyVocabulary(ValueError):
    """No term of the documents is left."""


def fit_tfidf(docs: DataFrame, params: TfidfParams, text_col: str = "text", id_col: str = "id",
              persist: bool = True) -> TfidfModel:
    """V08 fit. Runs two small actions (document count, vocabulary size).

    The vocabulary (bounded by ``max_features``) is cached, so later
    transforms reuse it. An empty vocabulary is an error.
    """
    n_docs = docs.count()
    # Term statistics (one row per distinct term) are persisted so the exact
    # top-k cut reads them instead of re-analysing the text.
    if counted_in_tasks(params):
        sums = term_statistics(staged_texts(docs, params, text_col, id_col), params)
        stats = frequent_terms(sums, params, F.lit(n_docs)).persist()
    else:
        stats = document_frequencies(term_counts(docs, params, text_col, id_col), params, F.lit(n_docs), id_col).persist()
    vocab = fit_vocabulary(None, n_docs, params, id_col, stats=stats)
    if persist:
        vocab = vocab.cache()
    size = vocab.count()
    stats.unpersist()
    if size == 0:
        raise EmptyVocabulary("empty vocabulary; perhaps the documents only contain stop words")
    return TfidfModel(params, vocab, n_docs, size, text_col, id_col)


def tfidf_fit_transform(docs: DataFrame, params: TfidfParams, text_col: str = "text",
                        id_col: str = "id", carry=()) -> tuple[DataFrame, DataFrame]:
    """Fit and transform on the same corpus in one lazy plan (no action):
    returns ``(long form, vocabulary)``.

    The text is repartitioned once; the same exchange feeds both the
    vocabulary branch and the transform branch (Spark reuses it).
    """
    src = partition_docs(docs.select(id_col, text_col, *carry), id_col)
    counts = term_counts(src, params, text_col, id_col, carry, partitioned=True)
    # The document count is a scalar subquery on the unshuffled input (only
    # the id column is read), so the plan stays lazy and adds no exchange.
    n = _scalar(docs.agg(F.count(F.lit(1)).alias("n")), "n")
    vocab = fit_vocabulary(counts, n, params, id_col)
    return transform_counts(counts, vocab, params, id_col, carry), vocab


def tfidf_long(docs: DataFrame, params: TfidfParams, text_col: str = "text", id_col: str = "id",
               carry=()) -> DataFrame:
    """Long-form TF-IDF of a corpus with its own vocabulary."""
    return tfidf_fit_transform(docs, params, text_col, id_col, carry)[0]


def _scalar(one_row: DataFrame, col: str) -> Column:
    """Use a one-row aggregate as a scalar subquery column."""
    return one_row.select(col).scalar()


def double_tfidf_long(docs: DataFrame, header_params: TfidfParams, body_params: TfidfParams,
                      header_col: str = "header", body_col: str = "body", id_col: str = "id",
                      header_size: int | None = None) -> DataFrame:
    """Independent header / body vocabularies; body indices follow the
    header vocabulary. Each side is L2-normed on its own."""
    h = tfidf_long(docs.select(id_col, F.col(header_col).alias("text")), header_params, id_col=id_col)
    b = tfidf_long(docs.select(id_col, F.col(body_col).alias("text")), body_params, id_col=id_col)
    if header_size is None:
        off = h.agg(F.max("idx").alias("m"))
        off_col = F.coalesce(_scalar(off, "m") + 1, F.lit(0))
    else:
        off_col = F.lit(int(header_size))
    return (h.withColumn("field", F.lit("header"))
            .unionByName(b.withColumn("field", F.lit("body")).withColumn("idx", F.col("idx") + off_col)))


def sparse_rows(long: DataFrame, ids: DataFrame | None, size: int, id_col: str = "id",
                idx_col: str = "idx", value_col: str = "weight") -> DataFrame:
    """Long form -> one ``SparseVector`` per id.

    Entries are collected per id (bounded by the vocabulary size) and sorted
    by index; ids without any entry are kept as zero vectors when ``ids`` is
    given. The vector itself is built by a small helper that gets the two lists in
    pickled batches of about 100 rows: an Arrow batch of 10,000 rows, each a list of
    structs, took a worker gigabytes.
    """
    from pyspark.ml.linalg import SparseVector, VectorUDT

    lists = getattr(long, "_lists", None)
    if lists is not None:
        # Dealt and ordered as the gathered rows are: a fit's sums follow the order of its rows.
        grouped = partition_docs(lists.where(F.size("f") > 0), id_col).select(
            id_col, F.struct(F.col("f").alias("i"), "v").alias("e")).hint("merge")
    else:
        grouped = long.groupBy(id_col).agg(
            F.array_sort(F.collect_list(F.struct(F.col(idx_col).cast("int").alias("i"),
                                                 F.col(value_col).cast("double").alias("v")))).alias("e"))
    if ids is not None:
        grouped = ids.select(id_col).join(grouped, id_col, "left")
    n = int(size)

    @F.udf(returnType=VectorUDT(), useArrow=False)
    def to_vec(i, v):
        return SparseVector(n, i or [], v or [])

    return grouped.select(id_col, to_vec("e.i", "e.v").alias("features"))


def feature_lists(long: DataFrame, ids: DataFrame, id_col: str = "id", idx_col: str = "idx",
                  value_col: str = "weight") -> DataFrame:
    """Long form -> ``(id, f, v)``: features in index order and, beside them, their
    values; ids without any entry have empty lists."""
    lists = getattr(long, "_lists", None)
    if lists is not None:
        grouped = lists.select(id_col, F.struct(F.col("f").alias("i"), "v").alias("e"))
    else:
        entry = F.struct(F.col(idx_col).cast("int").alias("i"), F.col(value_col).cast("double").alias("v"))
        grouped = long.groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return ids.select(id_col).join(grouped, id_col, "left").select(
        id_col, F.coalesce("e.i", F.array().cast("array<int>")).alias("f"), F.coalesce("e.v", F.array().cast("array<double>")).alias("v"))


def sklearn_idf(n: int, df: int) -> float:
    """Plain-Python smoothed IDF (used by tests)."""
    return math.log((1 + n) / (1 + df)) + 1.0
