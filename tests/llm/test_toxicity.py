"""op1: automata against edit distance, learning, context, held-out accuracy."""
import os
import random
import zlib

import pytest

from cartable.llm import toxicity as tx
from cartable.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = {t + "$": 1.0 + k / 100 for k, t in enumerate(["idiot", "moron", "clown", "worthless", "pathetic", "stupids"])}
    lexicon, rng = tx.Lexicon(terms), random.Random(1)
    words = []
    for _ in range(3000):
        w = list(rng.choice(list(terms)).rstrip("$"))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            rng.choice([lambda: w.insert(k, rng.choice("abilo")), lambda: w.pop(min(k, len(w) - 1)),
                        lambda: w.__setitem__(min(k, len(w) - 1), rng.choice("abilo"))])() if w else None
        words.append("".join(w))
    for w in words:
        near = [(distance(w, t[:-1]), t) for t in terms]
        near = [(d, t) for d, t in near if d <= tx.Lexicon.errors(t)]
        got = lexicon.fuzzy(w)
        assert (got is None) == (not near), w
        if near:
            least = min(d for d, _ in near)
            assert got == (max(terms[t] for d, t in near if d == least), least)


def test_quotation_and_address():
    lexicon = tx.Lexicon({"idiot$": 5.0, "idiot": 5.0})
    plain = lexicon.features("and then the idiot went home")
    quoted = lexicon.features('and then the word "idiot" went home')
    said = lexicon.features("he wrote idiot on the wall")
    you = lexicon.features("you idiot")
    assert plain[0] > 0 and plain[2] == 0 and quoted[0] == 0 and quoted[2] > 0 and said[2] > 0
    assert you[3] > 0 and plain[3] == 0
    whole = tx.Lexicon({"idiot$": 5.0})
    wrong = whole.features("the idoit went")
    right = whole.features("the idiott went")
    assert 0 < right[0] < whole.features("the idiot went")[0] and wrong[0] == 0  # a swap is two errors, five letters allow one
    assert lexicon.features(None) == lexicon.features("") == [0.0] * tx.FEATURES


def tables(spark, docs, labels):
    return (spark.createDataFrame([(i, t, "x", 0.5) for i, t in docs], "doc_id bigint, text string, lang string, score double"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_learns_and_scores(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["zorkle", "grumbfix"])
        docs.append((i, " ".join(w)))
        labels.append((i, None, int(bad)))
    docs += [(900, "zorkle zorkle grumbfixx"), (901, None), (902, ""), (903, "zorkle " * 100_000), (903, "zorkle"), (None, "zorkle")]
    labels += [(5, 1, 1), (None, 0, 1), (901, 0, None)]
    d, lab = tables(spark, docs, labels)
    got = tx.toxicity(d, lab).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 600}
    assert all(by[i].predicted == t for i, _, t in labels[:600])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.predicted for r in got if r.doc_id in (900, 903, None)} == {1}
    assert {r.predicted for r in got if r.doc_id in (901, 902)} == {0}
    kept = tx.keep_clean(d, lab)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted == 0)


@pytest.mark.parametrize("toxic", [[], [0], [1]])
def test_without_both_classes(spark, toxic):
    d, lab = tables(spark, [(0, "some text"), (2, None)], [(i, 0, t) for t in toxic for i in (0, 2, 3)])
    got = tx.toxicity(d, lab).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)
    assert tx.toxicity(d.limit(0), lab).count() == 0


def test_copies_add_no_terms(spark):
    """A rare word of one toxic text and its copies has one neighbourhood."""
    rows = [(i, "plain words and the zorkle word here", "x") for i in range(40)]
    rows += [(100 + i, f"other w{i}a w{i}b", "x") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    lab = spark.createDataFrame([(i, int(i < 100)) for i, _, _ in rows], "doc_id bigint, toxic int")
    (terms, _, _), _ = tx.train(d, lab)
    assert terms == {}


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, SF).collect()}
    docs = {r.doc_id: r.text.lower() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    clean = [got[i].predicted for i, t in held if not t]
    # Toxic documents of this table that hold any learnable word at all.
    seen = [got[i].predicted for i, t in held if t and any(w in docs[i] for w in ("idiot", "scum", "trash", "moron", "clown", "stupid",
                                                                                 "loser", "pathetic", "worthless", "disgusting"))]
    assert sum(clean) <= 0.02 * len(clean) and sum(seen) >= 0.95 * len(seen) > 5
    caught = [got[i].predicted for i, t in held if t]
    assert sum(caught) >= 0.75 * len(caught)  # recall over every held-out toxic row


def other_letter(piece, k=2):
    return piece[:k] + ("x" if piece[k:k + 1] != "x" else "y") + piece[k + 1:]


def test_misspelled_abuse_is_caught(spark):
    """Every hit of the held-out toxic rows misspelled: at least 0.9 of the
    recall; quotation and abuse are told apart, misspelled or not."""
    sf = "/root/testdata/check_s"
    if not os.path.exists(sf):
        pytest.skip("needs the larger table")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 12000")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = tx.train(docs, labels)
    scorer = tx.Scorer(*model)
    hit = scorer.lexicon.cache
    held = labels.where("toxic = 1").where(tx.held_out("doc_id")).select("doc_id").distinct()
    texts = [r.text for r in docs.join(held, "doc_id").collect()]
    plain = sum(scorer.score(t) >= tx.THRESHOLD for t in texts)
    for change in (other_letter, tx.slip):
        wrong = [" ".join(change(p) if hit[p] else p for p in t.lower().split()) for t in texts]
        assert sum(scorer.score(t) >= tx.THRESHOLD for t in wrong) >= 0.9 * plain > 50
    for abuse in ("you are an idiot", "you are an idot", "you idi0t"):
        assert scorer.score(abuse) >= tx.THRESHOLD, abuse
    for quoted in ('the word "idiot" appears in a study', 'the word "idot" appears in a study', "he wrote idiot on it"):
        assert scorer.score(quoted) < tx.THRESHOLD, quoted


def test_known_words_are_no_misspellings():
    lexicon = tx.Lexicon({"trash$": 5.0, "moron$": 5.0}, frozenset({"moron$"}), frozenset({"crash"}))
    assert lexicon.find("trxsh") == (5.0 * tx.DISCOUNT, 1) and lexicon.find("crash") is None
    assert lexicon.find("morxn") is None and lexicon.find("moron") == (5.0, 0)
    # Toxic share 0.2: one unknown word in 1,000 clean texts leaves trust, 30 do not.
    assert tx.exact_only({"a$": 1, "b$": 30}, {"a$": 0.2, "b$": 0.2}, 1000) == {"b$"}


def test_sample_is_bounded_in_rows(spark):
    """One id with a third of all rows, and one row repeated: the bound holds."""
    rows = [(i if i % 3 else 7, f"text {i}", i % 2) for i in range(3000)] + [(9999, "again", 1)] * 2000
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    scratch = tx.Scratch(spark, "test-toxicity")
    for most in (1, 100, 10_000):
        got = [tuple(r) for r in tx.fit_sample(d, len(rows), most, scratch).collect()]
        assert len(set(got)) == len(got) <= min(most, 3001)
    assert len(got) == 3001
    assert len(tx.fit_sample(d, len(rows), 100, scratch).collect()) >= 50


def test_slip_changes_a_letter():
    for piece in ("idiot", "a", "«scum!»", "café", "qqq"):
        assert tx.slip(piece) != piece and distance(piece, tx.slip(piece)) == 1


def test_every_whole_word_is_searched():
    words = ["grombel", "grombeler", "grombeling", "grombeled", "disgusting", "zak"]
    terms = {t: 5.0 for w in words for t in tx.terms_of(w)}
    assert {"disgusting$", "zak$", "grombe"} <= set(terms)
    find = tx.Lexicon(terms).find
    assert find("zak,") == (5.0, 0) and find("zap") is None
    for slip in ("gxombel", "gxombeler", "gormbeling", "dxsgusting", "dsgusting", "gr0mbel", "d!sgusting", "\"gr*mbel!\"", "grxmbelous"):
        assert find(slip) and find(slip)[1] > 0, slip
    assert find("gardens") is None and find("3.14159") is None
