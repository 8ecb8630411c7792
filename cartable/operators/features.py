"""Feature combinations: TF-IDF + keyword flags (V10), dictionary
lemmatisation (F08) and lemmatised TF-IDF (V11)."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import DEFAULT_KEYWORDS, keyword_flag, word_tokens
from ..session import ship
from . import tfidf as TF

# Largest dictionary (rows) that is broadcast; beyond it a shuffle join is used
# (AQE splits a hot form's partition).
BROADCAST_DICT_MAX_ROWS = 5_000_000
# One of at most this many rows goes to the tasks, which rewrite texts without a row per token.
SHIPPED_DICT_MAX_ROWS = 200_000


def checked_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when a count proves it small enough."""
    n = df.limit(max_rows + 1).count()
    return (F.broadcast(df), True) if n <= max_rows else (df, False)


def keyword_long(docs: DataFrame, offset, lexicon: dict | None = None, id_col: str = "id",
                 text_col: str = "text") -> DataFrame:
    """Keyword flags in long form ``(id, idx, weight)``; zeros are not stored."""
    lexicon = DEFAULT_KEYWORDS if lexicon is None else lexicon
    flags = F.array(*[F.struct(F.lit(j).alias("j"), keyword_flag(F.col(text_col), ws).alias("w"))
                      for j, ws in enumerate(lexicon.values())])
    e = docs.select(id_col, F.inline(flags))
    return (e.where(F.col("w") != 0)
            .select(id_col, (F.col("j") + offset).cast("int").alias("idx"), F.col("w").alias("weight")))


def feature_union_long(docs: DataFrame, params: TF.TfidfParams, lexicon: dict | None = None,
                       id_col: str = "id", text_col: str = "text") -> DataFrame:
    """TF-IDF columns first, then one column per keyword class."""
    long, vocab = TF.tfidf_fit_transform(docs, params, text_col, id_col)
    size = TF._scalar(vocab.agg(F.count(F.lit(1)).alias("v")), "v")
    kw = keyword_long(docs, size, lexicon, id_col, text_col)
    return long.select(id_col, F.col("idx").cast("int").alias("idx"), "weight").unionByName(kw)


def plural_lemma_dictionary(docs: DataFrame, text_col: str = "text", min_len: int = 4) -> DataFrame:
    """A ``(form, lemma)`` dictionary derived from the corpus itself: a token
    ending in ``s`` or ``x`` maps to the token without that letter when that
    shorter token also occurs in the corpus."""
    ship(docs.sparkSession)

    def words(batches):  # distinct ones of some texts, so a token is no row
        seen: set = set()
        for batch in batches:
            for i in range(batch.num_rows):
                seen.update((batch.column(0)[i].as_py() or "").split(" "))
                if len(seen) > TF.HELD_TERMS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["form"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], ["form"])

    tok = docs.select(F.array_join(word_tokens(F.col(text_col)), " ").alias("t")).mapInArrow(words, "form string").where("form <> ''")
    # A token meets the forms it may be the lemma of: one pass over the texts serves both.
    cand = (F.length("form") >= min_len) & F.col("form").rlike("[sx]$")
    none = F.lit(None).cast("string")
    meets = tok.select(F.inline(F.array(
        F.struct(F.col("form").alias("lemma"), none.alias("form")),
        F.struct(F.when(cand, F.expr("substring(form, 1, length(form) - 1)")).alias("lemma"), F.when(cand, F.col("form")).alias("form")))))
    met = meets.where("lemma is not null").groupBy("lemma").agg(F.max(F.col("form").isNull()).alias("known"), F.collect_set("form").alias("forms"))
    return met.where("known").select(F.explode("forms").alias("form"), "lemma")


def lemmatize(docs: DataFrame, dictionary: DataFrame, id_col: str = "id", text_col: str = "text",
              out: str = "text", max_broadcast_rows: int = BROADCAST_DICT_MAX_ROWS) -> DataFrame:
    """replace each word token by its dictionary lemma (unknown -> itself)
    and re-join in text order; punctuation and whitespace tokens disappear.

    The tokens of one document are regrouped by id (a group is one document). A
    dictionary that is small by count goes to the tasks, where a text is rewritten whole.
    """
    few = min(max_broadcast_rows, SHIPPED_DICT_MAX_ROWS)
    rows = dictionary.select("form", "lemma").limit(few + 1).collect()
    lemma_of = {r["form"]: r["lemma"] for r in rows if r["lemma"] is not None}
    if len(rows) <= few and len({r["form"] for r in rows}) == len(rows):
        return _lemmatized_in_tasks(docs, lemma_of, id_col, text_col, out)
    d, _ = checked_broadcast(dictionary.select("form", "lemma"), max_broadcast_rows)
    # Partition by id first: with a broadcast dictionary the regroup below
    # then needs no exchange (the text moves once, not every token).
    src = TF.partition_docs(docs.select(id_col, text_col), id_col)
    toks = src.select(id_col, F.posexplode(word_tokens(F.col(text_col))).alias("pos", "form"))
    j = toks.join(d, "form", "left").select(id_col, "pos", F.coalesce("lemma", "form").alias("lemma"))
    grouped = j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("_l"))
    back = grouped.select(id_col, F.array_join(F.transform("_l", lambda s: s["lemma"]), " ").alias(out))
    # Documents without any token keep an empty text.
    return docs.select(id_col).join(back, id_col, "left").select(
        id_col, F.coalesce(F.col(out), F.lit("")).alias(out))


def _lemmatized_in_tasks(docs: DataFrame, lemma_of: dict, id_col: str, text_col: str, out: str) -> DataFrame:
    """``lemmatize`` by a dictionary in which no form repeats. The texts of a repeated id
    are one document (tokens by place, then lemma), and rows without an id stay empty."""
    ship(docs.sparkSession)

    def work(texts: pa.Array) -> pa.Array:
        done = []
        for i in range(len(texts)):
            tokens = [[lemma_of.get(t, t) for t in text.split(" ")] for text in texts[i].as_py() or [] if text]
            if len(tokens) > 1:
                tokens = [[t for _, t in sorted((at, t) for line in tokens for at, t in enumerate(line))]]
            done.append(" ".join(tokens[0]) if tokens else "")
        return pa.array(done, pa.string())

    src = TF.partition_docs(docs.select(id_col, text_col), id_col).select(
        id_col, F.array_join(word_tokens(F.col(text_col)), " ").alias("_t"))
    rows = src.select(id_col, F.collect_list("_t").over(Window.partitionBy(id_col)).alias("_t"))
    text = F.arrow_udf(work, "string")("_t")
    return rows.select(id_col, F.when(F.col(id_col).isNull(), F.lit("")).otherwise(text).alias(out))


def lemmatized_tfidf_long(docs: DataFrame, params: TF.TfidfParams, dictionary: DataFrame | None = None,
                          id_col: str = "id", text_col: str = "text") -> DataFrame:
    """F08 then TF-IDF, ``(id, idx, weight)``."""
    dictionary = plural_lemma_dictionary(docs, text_col) if dictionary is None else dictionary
    lem = lemmatize(docs, dictionary, id_col, text_col)
    if not TF.counted_in_tasks(params) or (params.max_features or TF.SHIPPED_VOCAB_MAX + 1) > TF.SHIPPED_VOCAB_MAX:
        return TF.tfidf_long(lem, params, "text", id_col).select(id_col, F.col("idx").cast("int").alias("idx"), "weight")
    try:
        return TF.fit_tfidf(lem, params, "text", id_col).features(lem)
    except TF.EmptyVocabulary:
        return lem.select(id_col, F.lit(0).alias("idx"), F.lit(0.0).alias("weight")).limit(0)
