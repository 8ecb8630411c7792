"""Quality rules as a learned decision list (native: column expressions only).

Every text is measured once (words, symbols, repeated lines, words inside
repeated windows, ...). Labelled rows then teach an ordered list of rules by
sequential covering: a rule is a conjunction of thresholds grown condition by
condition (information gain on two thirds of the labelled rows) and pruned on
the other third; rows it covers leave, and the next rule is grown on the rest.
All counts are grouped aggregates over (feature, bin, class), so the driver sees
bins, never rows. The list becomes one ``CASE WHEN`` over the measured columns.

Defined cases: null, empty and blank texts have no words and fail the base rule;
null ids keep their row; repeated rows are measured and judged alike; ties
between conditions go to the earlier feature, then ``>=`` before ``<``, then the
lower threshold; an empty table gives no rows; without usable labels there is no
rule and the base rule decides alone. Other columns of the input are not read. A
very long text is one array of its windows (16 bytes a word) inside its own task.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3            # words of a repeated window
BINS = 64             # quantile steps per class and feature; both ends are thresholds too
MAX_RULES, MAX_CONDITIONS = 16, 4
MIN_PRECISION = 0.95  # share of bad rows among those a rule covers, on the pruning rows
MIN_COVER = 3         # pruning rows a rule must cover

# Features the rules may test: name -> expression over the measured columns.
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "repeat_share": "n_repeat_words / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "capital_share": "n_capitals / word_chars",
    "mark_share": "n_marks / word_chars",
    "digit_share": "n_digits / word_chars",
    "words_per_line": "n_words / n_lines",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # ">=" or "<"
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return F.coalesce(x >= F.lit(self.threshold) if self.op == ">=" else x < F.lit(self.threshold), F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _only(text: Column, chars: str) -> Column:
    """How many of the characters of a class a text holds."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def statistics(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The measured columns of every text; ``keep`` columns stay.

    ``n_repeat_words`` counts words covered by a window of three words that
    occurs twice or more in the text. Windows are compared by 64-bit hashes; the
    hashes are sorted with their places, so the work is n log n in the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], t.alias("_t"),
                    F.array_remove(F.split(t, SPACE), "").alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = F.transform("_w", lambda x, i: F.xxhash64(x, *[F.get("_w", i + j) for j in range(1, WINDOW)]))
    d = d.select("*", lines.alias("_l"), F.slice(hashed, F.lit(1), F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))).alias("_g"))
    # Windows in the order of (hash, place); repeated ones have an equal neighbour.
    placed = F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.array().cast("array<struct<h:bigint,i:int>>"))
                     .otherwise(placed))
    beside = lambda x, i: F.coalesce(x["h"] == F.get("_s", i)["h"], F.lit(False))
    twice = F.filter("_s", lambda x, i: beside(x, i - 1) | beside(x, i + 1))
    d = d.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
                          lambda a: a["n"])
    return d.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        _only(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _only(F.col("_t"), "A-Z").alias("n_capitals"),
        _only(F.col("_t"), "!?").alias("n_marks"),
        _only(F.col("_t"), "0-9").alias("n_digits"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thresholds(rows: DataFrame) -> list[list[float]]:
    """Candidate thresholds of each feature: quantiles of either class."""
    cuts = [i / BINS for i in range(BINS + 1)]
    q = [F.percentile_approx(F.expr(e), cuts, 10000).alias(f) for f, e in FEATURES.items()]
    by_class = rows.groupBy("y").agg(*q).collect()  # two rows
    return [sorted({float(x) for r in by_class for x in (r[f] or ())}) for f in FEATURES]


def learn(stats: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", id_col: str = "doc_id") -> list[Rule]:
    """Sequential covering. Rows labelled 0 are the ones to reject; an id labelled
    twice counts as bad if any label says so. Rows that the base rule rejects
    teach nothing, as no rule will see their like."""
    y = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col)
         .agg(F.min(F.col(label).cast("int")).alias("y")).select(F.col(id_col).alias("_id"), (F.col("y") == 0).alias("y")))
    rows = scratch.write(stats.where(~base_failed()).join(y, F.col(id_col) == F.col("_id"))
                         .withColumn("grow", F.crc32(F.col("_id").cast("string")) % 3 != 2), "labelled")
    cuts = thresholds(rows)
    def bin_of(feature: Column, cut: list[float]) -> Column:  # thresholds at or below the value; -1 if undefined
        below = F.filter(F.array(*map(F.lit, cut)).cast("array<double>"), lambda t: t <= feature)
        return F.when(feature.isNull(), -1).otherwise(F.size(below))

    bins = F.array(*[bin_of(F.expr(e), c) for e, c in zip(FEATURES.values(), cuts)])
    rows = scratch.write(rows.withColumn("bins", bins), "binned")
    names, rules, left = list(FEATURES), [], rows
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            best = _best(_histogram(_matching(left.where("grow"), rule)), names, cuts)
            if best is None:
                break
            rule.append(best)
        kept = _prune(left.where(~F.col("grow")), rule)
        if not kept:
            break
        rules.append(kept)
        left = left.where(~_all(kept))
    scratch.drop(rows)
    return rules


def _all(rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _matching(rows: DataFrame, rule) -> DataFrame:
    return rows.where(_all(rule)) if rule else rows


def _histogram(rows: DataFrame) -> dict:
    """Rows per (feature, bin, class): at most features x thresholds x 2 counts."""
    e = rows.select("y", F.posexplode("bins").alias("f", "b"))
    return {(r["f"], r["b"], r["y"]): r["n"] for r in e.groupBy("f", "b", "y").agg(F.count(F.lit(1)).alias("n")).collect()}


def _best(hist: dict, names: list[str], cuts: list[list[float]]) -> Condition | None:
    """The condition of the largest information gain, or None if none gains."""
    bad = sum(n for (f, _, y), n in hist.items() if f == 0 and y)
    good = sum(n for (f, _, y), n in hist.items() if f == 0 and not y)
    if not bad or not good:
        return None
    before, best, gain = math.log2(bad / (bad + good)), None, 1e-9
    for f, c in enumerate(cuts):
        at = [[hist.get((f, b, y), 0) for b in range(len(c) + 1)] for y in (True, False)]
        for op in (">=", "<"):
            for b in range(1, len(c) + 1):
                p, n = (sum(a[b:]) if op == ">=" else sum(a[:b]) for a in at)
                if p and (g := p * (math.log2(p / (p + n)) - before)) > gain:
                    best, gain = Condition(names[f], op, c[b - 1]), g
    return best


def _prune(rows: DataFrame, rule: list[Condition]) -> Rule:
    """The prefix of a rule with the best (bad - good) / (bad + good) on the pruning
    rows, the shortest of equals; empty if it is not precise enough there."""
    if not rule:
        return ()
    sums = [F.coalesce(F.sum((_all(rule[:i]) & (F.col("y") == v)).cast("long")), F.lit(0)).alias(f"{k}{i}")
            for i in range(1, len(rule) + 1) for k, v in (("p", True), ("n", False))]
    r = rows.agg(*sums).first()
    worth = lambda i: (r[f"p{i}"] - r[f"n{i}"]) / max(r[f"p{i}"] + r[f"n{i}"], 1)
    i = max(range(1, len(rule) + 1), key=lambda i: (worth(i), -i))
    p, n = r[f"p{i}"], r[f"n{i}"]
    return tuple(rule[:i]) if p + n >= MIN_COVER and p >= MIN_PRECISION * (p + n) else ()


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row, 0 for the base rule, null if none does."""
    out = F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules, 1):
        out = out.when(_all(rule), F.lit(i))
    return out


def quality(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rule)`` for every row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    stats = scratch.write(statistics(docs), "statistics")
    rules = learn(stats, labels, scratch)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", F.col("rule").isNull().alias("kept"), "rule")
