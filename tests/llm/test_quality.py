"""Quality rules: statistics against a plain count, rules on held-out rows, edge cases."""
import re
from collections import Counter

from pyspark.sql import functions as F

from cartable.llm import quality as Q
from cartable.llm.common import Scratch, table
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def as_row(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


def test_statistics_of_edge_texts(spark):
    texts = [None, "", " \t\x0b\n", "a", "a a a a", "a b c a b c", "x y z\n\nx y z\n x y z", "a b a b a b a",
             "# * $ % & | < > é b", "w " * 5000, " ".join(str(i % 977) for i in range(20000)), "a b c d a b c e b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: as_row(r) for r in Q.statistics(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_query_rows_equal_plain_count(spark):
    from __spark_entry__ import queries
    rows = queries()["op13_quality_rules"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        n_words, *_, repeat = want = plain(docs[r["doc_id"]])
        assert as_row(r) == want
        assert r["base_failed"] == (n_words < 50 or 100 * repeat > 50 * n_words)
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (r["rule"] is None)


def test_rules_hold_on_rows_they_never_saw(spark, tmpdir_path):
    sf = SF.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    unseen = F.crc32(F.concat(F.lit("held"), F.col("doc_id").cast("string"))) % 3 == 0
    out = Q.quality(docs, labels.where(~unseen)).join(labels.where(unseen), "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)]


def _labelled(spark, rows):
    """Rows of ready-made statistics: (id, symbols, capitals, quality) over 100 words."""
    stats = spark.createDataFrame(
        [(i, 100, 500, s, 0, 0, 10, c, 0, 0) for i, s, c, _ in rows],
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
        "n_capitals long, n_marks long, n_digits long")
    return stats, spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")


def test_covering_learns_two_rules_and_a_conjunction(spark):
    # Bad: many symbols; or many capitals together with few symbols' worth of text (a conjunction with good look-alikes).
    rows = [(i, 200 + i % 7, i % 50, 0) for i in range(60)] + [(100 + i, 0, 400 + i % 9, 0) for i in range(60)]
    rows += [(200 + i, i % 20, i % 50, 1) for i in range(300)] + [(600 + i, 30 + i % 20, 400 + i % 9, 1) for i in range(120)]
    stats, labels = _labelled(spark, rows)
    rules = Q.learn(stats, labels, Scratch(spark, "t"))
    assert len(rules) >= 2 and any(len(r) > 1 for r in rules)
    out = stats.withColumn("rule", Q.verdict(rules)).join(labels, "doc_id").collect()
    assert all((r["rule"] is None) == (r["quality"] == 1) for r in out)


def test_noise_teaches_no_rule(spark):
    rows = [(i, (i * 7919) % 31, (i * 104729) % 37, int((i * 2654435761) % 97 > 20)) for i in range(400)]
    stats, labels = _labelled(spark, rows)
    assert Q.learn(stats, labels, Scratch(spark, "t")) == []


def test_empty_tables_null_ids_and_extra_columns(spark):
    schema = "doc_id long, text string, n_words long, kept string, y int, _id long, bins string"
    docs = spark.createDataFrame([(None, "a " * 60, 1, "x", 1, 1, "b"), (1, None, 1, "x", 1, 1, "b"), (1, None, 1, "x", 1, 1, "b")], schema)
    labels = spark.createDataFrame([(None, 0), (1, None), (1, 0)], "doc_id long, quality int")
    out = Q.quality(docs, labels).collect()
    assert len(out) == 3 and all(r["base_failed"] and not r["kept"] for r in out)
    assert Q.quality(docs.limit(0), labels.limit(0)).count() == 0
    assert Q.quality(docs, labels.limit(0)).count() == 3


def test_no_python_in_the_plan(spark):
    plan = Q.statistics(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
