"""op4, op5, op8, op9 on literal cases and against plain Python."""
import random
import re
import zlib

import pytest

from cartable.llm import decontam, html, license, shard
from cartable.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_hilbert_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        df = spark.range(side ** dims).selectExpr(*[f"cast((id div {side ** k}) % {side} as int) as a{k}" for k in range(dims)])
        got = shard.hilbert(df, [f"a{k}" for k in range(dims)], bits, "h").orderBy("h").collect()
        assert [r.h for r in got] == list(range(side ** dims))
        assert all(sum(abs(x - y) for x, y in zip(p[:dims], q[:dims], strict=True)) == 1 for p, q in zip(got, got[1:], strict=False))


def check_shards(rows, got, n):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < n
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [1, 5, 16])
def test_shards(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([i, i, 7]), rng.choice(["a", "é" * i, "", None]), rng.choice(["en", "en", "de", None]), rng.choice([None, 1.5, 9.0]), "c")
            for i in range(137)] + [(None, "x" * 100_000, "zz", 3.0, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, w double, shard string")
    check_shards([r[:2] for r in rows], shard.hilbert_shards(df, ["lang", "w"], n).collect(), n)
    assert shard.hilbert_shards(df.limit(0), ["lang", "w"], n).count() == 0


def test_op4_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op4_hilbert_shards"](spark, SF).collect()
    check_shards(rows, got, 16)
    curve = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)


def test_license_forms(spark):
    mit = license.TEXTS["MIT"]
    other = mit.replace("<year> <copyright holders>", "2019 Someone").replace("license", "licence").replace("\n", "\r\n  ").upper()
    rows = [(1, mit), (2, other), (3, "x\nreleased under the MIT licence\ny"), (4, None), (5, ""), (6, "Copyright (c) 2020 x"),
            (7, "..."), (8, mit + " And more."), (9, "Released under the MIT License."), (9, "Released under the MIT License.")]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id bigint, text string, license string")
    got = {(r.doc_id, r.license, r.unit, r.n) for r in license.scan(df, license.known(spark)).collect()}
    assert got == {(1, "MIT", "text", 1), (2, "MIT", "text", 1), (3, "MIT", "line", 1), (9, "MIT", "line", 2), (9, "MIT", "text", 2)}
    assert license.scan(df.limit(0), license.known(spark)).count() == 0


def test_templates(spark):
    item = ("If a train leaves Boston with Mary at 60 km and then Mary walks 60 minutes more to reach the old station, "
            "how far does she go before the 12 dogs find Peter?")
    again = item.replace("Mary", "Anna").replace("60 km", "85 mi").replace("60 minutes", "85 hours").replace("12", "7").replace("Boston", "Paris")
    odd = again.replace("Anna walks 85", "Berta walks 31")  # one value of the item now stands for two
    half = " ".join(item.split()[:16])
    docs = [(1, "Intro here. " + item + " End."), (2, "Other words,\n" + again), (3, odd), (4, half), (5, None), (6, ""),
            (7, item.upper().replace("?", "")), (8, "word " * 300_000 + item), (1, "Intro here. " + item + " End."), (9, "tiny item"),
            (10, "A tiny item, of course"), (None, again)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, item_id string, hash int")
    items = spark.createDataFrame([(10, item), (11, "a tiny item"), (12, None), (13, "")], "item_id bigint, text string")
    got = decontam.contaminated(df, items).collect()
    pairs = sorted((r.doc_id or 0, r.item_id) for r in got)
    assert pairs == [(0, 10), (1, 10), (2, 10), (7, 10), (8, 10), (10, 11)]
    assert all(0.6 <= r.coverage <= 1 and r.consistency >= 0.8 for r in got)
    assert decontam.contaminated(df.limit(0), items).count() == 0
    assert decontam.contaminated(df, items.limit(0)).count() == 0


def test_every_occurrence_is_judged(spark):
    item = ("If a train leaves Boston with Mary at 60 km and then Mary walks 60 minutes more to reach the old station, "
            "how far does she go before the 12 dogs find Peter?")
    again = item.replace("Mary", "Anna").replace("60 km", "85 mi").replace("60 minutes", "85 hours").replace("12", "7")
    more = item.replace("Mary", "Mary Ann").replace("60 km", "9 mi").replace("60 minutes", "9 hours").replace("Boston", "Rome")
    odd = again.replace("Anna walks 85", "Berta walks 31")
    roles = item.replace("60 km", "85 km").replace("60 minutes", "31 minutes")  # one number in two roles
    docs = [(1, item + "\n" + again), (2, " ".join((again, more, item, again.replace("Anna", "Eve").replace("85", "4")))),
            (3, odd), (4, roles), (5, odd + "\n" + odd), (6, odd), (6, item)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(10, item)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(df, items).collect()) == [1, 2, 4, 6]


def test_passages_and_names_anywhere(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(300))
    word = ('Mary has three apples. Peter gives her 5 more. "Mary eats twenty-one days later (Peter watches). Mary sells the rest '
            "of the apples. How many are left?")
    swap = lambda t, *p: re.sub("|".join(a for a, _ in p), lambda m: dict(p)[m[0]], t)
    other = swap(word, ("Mary", "Joan"), ("Peter", "Karl"), ("three", "nine"), ("5", "8"), ("twenty-one", "40"))
    german = "dann ging der Hund mit dem Ball in das Haus und der Vater sah das Kind mit dem Brot auf der Bank"
    docs = [(1, "before " + " ".join(long.split()[60:210]) + " after"), (2, other), (3, german.lower()),
            (4, "x " + " ".join(long.split()[60:75])), (5, " ".join(long.split()[::2]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(10, long), (11, word), (12, german)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(df, items).collect())
    assert got == [(1, 10), (2, 11), (3, 12)]


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {tuple(r) for r in decontam.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert one and {tuple(r) for r in decontam.contaminated(docs, items).collect()} == one


def test_op8_equals_brute_force(spark):
    word = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, grams(word(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for w in [grams(word(t))] for i, g in items if len(g & w) >= 0.6 * len(g)}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op8_template_decontamination"](spark, SF).collect()} == want


def page(menu, body, foot):
    return (f"<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><ul>{menu}</ul>{body}"
            f"<p>{foot}</p></body></html>")


def test_differencing_deletes_shared_lines(spark):
    menu = "<li>Home</li><li>News</li>"
    rows = [(1, "http://www.h.org/a/1", page(menu, "<p>first  text &amp; more<br>second</p>", "About us")),
            (2, "https://h.org/a/2.html?x=1", page(menu, "<p>other</p><div>text<b>s</b></div>", "About us")),
            (3, "http://h.org/zzz", page(menu, "<p>third</p>", "About us")),
            (4, "http://lonely.org/", page(menu, "<p>alone</p>", "foot")),
            (5, None, None), (6, "http://e.org", ""), (7, "http://c.org/1", page("", "<p>same</p>", "x")),
            (7, "http://c.org/1", page("", "<p>same</p>", "x")), (8, "http://c.org/2", page("", "<p>same</p>", "x"))]
    df = spark.createDataFrame([(i, u, h, "t", 1) for i, u, h in rows], "page_id bigint, url string, html string, text string, host int")
    got = [tuple(r) for r in html.extract(df.coalesce(1)).collect()]
    texts = sorted((g[0], g[2]) for g in got)
    assert texts == [(1, "first text & more second"), (2, "other texts"), (3, "third"), (4, "Home News alone foot"),
                     (5, ""), (6, ""), (7, "same x"), (7, "same x"), (8, "same x")]
    assert all(g[3] == len(g[2]) for g in got)
    assert html.extract(df.limit(0)).count() == 0


def test_structure():
    t = lambda h: html.main_text(html.lines(h), None)
    assert t("<article><h1>T</h1><p>a<p>b</article><div>c</div>") == "T a b"
    assert t('<p>a</p><div class="side-bar comments"><p>x</p><div>y</div></div><p>b') == "a b"
    assert t("a<!-- x --><nav>n<nav>m</nav>o</nav>b<style>p{}</style><form>f</form>") == "a b"
    assert t("x &lt;b&gt; &#233;&nbsp;&copy;  y < z") == "x <b> é © y < z"
    assert t('<p title="a>b">q</p><script>if (a</b) "</p>"</script>r') == "q r"
    assert t("<script>never closed <p>x") == ""
    shared = [("menu", False), ("copied", True)]
    assert html.main_text(shared + [("own", True)], shared) == "copied own"


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_partners_do_not_depend_on_partitions(spark, monkeypatch, parts):
    monkeypatch.setattr(html, "SPOOLED", 8, raising=False)
    body = lambda h, k, x: f"<ul><li>menu {h}</li></ul><p>{x} {k}</p>"
    rows = [(k, f"http://h{k % 3}.org/{k:03}", body(k % 3, k, "page")) for k in range(60)]
    rows += [(100 + k, "http://h1.org/000", body(1, 0, "copy")) for k in range(50)]  # a long run, first on its host
    rows += [(200 + k, f"http://z.org/{k}", body(9, k // 30, "run")) for k in range(60)] + [(None, "http://z.org/0", body(9, 0, "run"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(((r.page_id or 0), r.text) for r in html.extract(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(((i or 0), re.search("<p>(.*)</p>", h)[1]) for i, _, h in rows)


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>t</title><meta charset=x><body><p>one<p>two", ["one", "two"]),
    ("<head><title>t</title>\n<p>one", ["one"]),
    ("<head><title>t</title>bare", ["bare"]),
    ('<div><p class="ad">buy<p>one<p>two</div><p>three', ["one", "two", "three"]),
    ('<div><p class="ad">buy <b>now</b></div>three', ["three"]),
    ('<ul><li class="share">tweet<li>one<li>two</ul><p>three', ["one", "two", "three"]),
    ('<ul><li class="share">tweet<ul><li>x</ul><li>one</ul>two', ["one", "two"]),
    ('<select><option>a<option>b</select>one', ["one"]),
    ('<article><div class="ad">buy</article><p>one', ["one"]),
    ('<div class="content has-sidebar"><p>one</div>', ["one"]),
    ('<article class="post has-comments"><p>one</article>', ["one"]),
    ('<main id="search-results"><p>one</main>', ["one"]),
    ('<div class="entry social-share-on"><p>one</div>', ["one"]),
    ('<div class="sidebar"><p>x</p><article><p>one</article></div>', ["one"]),
    ('<div class="site-footer">x</div><div id="cookie_notice-2">y</div><div class="a ad">z</div>one', ["one"]),
    ('<article>one<div class="comments"><article>x</article></div>two</article>', ["one", "two"])])
def test_implied_ends_and_whole_marks(source, want):
    assert [t for t, _ in html.lines(source)] == want


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html.common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_op9_gives_the_articles(spark):
    from html import unescape

    def article(h):
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", p))).strip() for p in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
        return " ".join(p for p in parts if p)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["op9_page_differencing"](spark, SF).collect()}
    assert got == {i: article(h) for i, h in pages.items()}


def test_anchor_filter_keeps_every_document_that_can_match(spark, monkeypatch):
    """With and without the first pass over pairs of words, the same pairs are found,
    also for items that have no two literal words side by side."""
    from cartable.llm import decontam
    from cartable.llm.common import Scratch
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()
    story = " ".join(words[(i * i + 3 * i) % 12] + str("abc"[i % 3]) for i in range(60))
    items = [(1, "If Anna has 12 apples and gives 3 apples to Bert, how many apples are left for Anna to eat?"), (2, story),
             (3, "the 1 the 2 the 3 the 4 the 5 the 6 the 7"), (4, "two words")]
    docs = [(1, items[0][1]), (2, items[0][1].replace("12", "99").replace("Anna", "Zoe")), (3, "x " + " ".join(story.split()[20:46]) + " y"),
            (4, " ".join(story.split()[:20])), (5, items[2][1]), (6, "so two words it is"), (7, None), (8, ""), (9, "apples and pears " * 30),
            (10, items[0][1].lower()), (11, items[0][1].upper()), (None, story)]
    ds, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    own = decontam.item_windows(it, Scratch(spark, "t"), 5)
    assert decontam.candidates(ds, own, Scratch(spark, "t"), 5, 0.6) is None  # item 3 has no anchor
    some = it.where("item_id <> 3")
    kept = decontam.candidates(ds, decontam.item_windows(some, Scratch(spark, "t"), 5), Scratch(spark, "t"), 5, 0.6)
    assert {9, 8, 7} & {r.doc_id for r in kept.collect()} == set()
    found = {frozenset(decontam.contaminated(ds, i).collect()) for i in (some,)}
    everything = {frozenset(decontam.contaminated(ds, i).collect()) for i in (it,)}
    monkeypatch.setattr(decontam, "candidates", lambda *a: None)
    assert found == {frozenset(decontam.contaminated(ds, some).collect())}
    assert everything == {frozenset(decontam.contaminated(ds, it).collect())}
    assert {(None, 2), (1, 1), (2, 1), (3, 2)} <= {(r.doc_id, r.item_id) for f in found for r in f}
