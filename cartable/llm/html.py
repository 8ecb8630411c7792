"""Main text of web pages by nearest-URL page differencing.

Pages are ordered by host and URL path; each page is paired with the neighbour
on the same host whose path starts like its own. Both are cut into text lines
(one per block element), the lines are aligned by a longest common subsequence,
and shared lines - menus, adverts, footers of the site's template - are deleted.

What differencing cannot see is settled by structure: lines in elements that
never hold article text (navigation, forms, scripts, asides, comments ...) go
even if the neighbour has others there, and a shared line stays if both copies
lie inside an article or main element, because then it is text that two articles
have in common. Pages that mark an article give its lines only.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce
from html import unescape
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ordered_index

SPOOLED = 4096  # rows of a run that a task holds before it writes them to a file

# HTML element classes.
SKIPPED = frozenset("""nav footer aside form script style noscript template svg math button select option textarea
    iframe object embed applet canvas audio video head title menu dialog""".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp
    small span strike strong sub sup time tt u var wbr""".split())
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
# Words of class, id and role attributes that mark what is not the article, and
# words beside them that name a place or a box: a name of both kinds alone is a
# mark (site-footer), others only mention one (has-sidebar).
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent
    notice notices alert popup modal newsletter subscribe sidebar menu navbar navigation nav breadcrumb breadcrumbs
    pagination pager share sharing social related recommended comments comment disqus respond footer complementary
    contentinfo search masthead""".split())
PLACES = frozenset("""a access area article articles aside bar block body bottom box btn button buttons center col column
    container content div entry first footer form global group header holder icon icons inline inner item items last left
    link links list main media mobile module nav outer overlay page panel post posts primary right row secondary section
    site slot small story sticky text thread title top unit widget widgets wrap wrapper""".split())
# Elements whose start ends an open paragraph, heads' own elements,
# and elements that end tags and implied ends do not reach out of.
ENDS_P = frozenset("""address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul
    xmp""".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes script style title noscript".split())
TABLE = frozenset("table caption colgroup tbody thead tfoot tr td th".split())
SCOPE = frozenset("table caption td th template object applet marquee button select svg math".split())
LISTS = frozenset("ul ol menu dir dl".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
        "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"),
        "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPACE = re.compile(r"\s+")


def _ended(tag: str, closing: bool, open_: list[str]) -> int:
    """How many open elements stay when this tag comes (HTML's implied ends): an
    end tag ends what lies inside its element, the start of a block a paragraph,
    a list or table part its sibling, anything that is no part of a head the head."""
    n = len(open_)
    if closing:
        if tag in ("body", "html"):
            return n
        for i in range(n - 1, -1, -1):
            x = open_[i]
            if x == tag:
                return i
            if (x in SCOPE and not (tag in TABLE and x in TABLE)) or (tag in INLINE and x not in INLINE) or (
                    tag in SAME and tag not in TABLE and x in LISTS):
                return n
        return n
    if "head" in open_ and tag not in IN_HEAD:
        n = open_.index("head")
    if tag in ENDS_P:
        for i in range(n - 1, -1, -1):
            if open_[i] == "p":
                n = i
                break
            if open_[i] in SCOPE:
                break
    if siblings := SAME.get(tag):
        table = tag in TABLE
        for i in range(n - 1, -1, -1):
            x = open_[i]
            if x in siblings:
                return i
            if x == "table" if table else x not in INLINE and x not in ("address", "div", "p", "option"):
                break
    return n


def lines(html: str) -> list[tuple[str, bool]]:
    """Text lines outside skipped elements, and whether each lies in an article
    or main element."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    open_: list[str] = []
    skip, wrapper, main, seen = -1, False, 0, False  # place of the skipped element in open_, whether a mark made it one
    at, end = 0, len(html)

    def close():
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        parts.clear()
        if text:
            out.append((text, main > 0))

    for_next = _TOKEN.search
    while at < end:
        m = for_next(html, at)
        piece = html[at:m.start() if m else end]
        if skip >= 0 and open_[skip] == "head" and len(open_) == skip + 1 and piece.strip():
            del open_[skip:]  # text is no part of a head
            skip = -1
        if skip < 0:
            parts.append(piece)
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in RAW and not closing:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else end
            continue
        if skip < 0 and tag not in INLINE:
            close()
        if (stay := _ended(tag, closing, open_)) < len(open_):
            if skip < 0 and main and any(x in MAIN for x in open_[stay:]):
                close()
            if skip >= stay:
                skip = -1
            del open_[stay:]
            main = sum(x in MAIN for x in open_) if main else 0
        if closing or tag in VOID or m[3].endswith("/"):
            continue
        open_.append(tag)
        if skip >= 0:
            # A marked element that holds the page's first article is its wrapper.
            if not (tag in MAIN and wrapper and not seen):
                continue
            skip = -1
        if tag in SKIPPED or (tag == "header" and not main):
            marked = structural = True
        else:
            structural = False
            # Articles inside an article are its comments or teasers if marked so.
            marked = bool(m[3]) and tag not in ("html", "body") and (tag not in MAIN or main > 0) and _marked(m[3])
        if marked:
            close()
            skip, wrapper = len(open_) - 1, not structural
        elif tag in MAIN:
            main, seen = main + 1, True
    close()
    return out


def _marked(attributes: str) -> bool:
    for m in _ATTR.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = _WORD.findall(_CAMEL.sub(r"\1-\2", name).lower() if not name.islower() else name)
            if any(w in MARKS for w in words) and all(w in MARKS or w in PLACES or len(w) == 1 for w in words):
                return True
    return False


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence (Hunt and Szymanski, 1977):
    equal ends are taken off, then the longest chain over the matches."""
    low, high_a, high_b = 0, len(a), len(b)
    while low < min(high_a, high_b) and a[low] == b[low]:
        low += 1
    while high_a > low and high_b > low and a[high_a - 1] == b[high_b - 1]:
        high_a, high_b = high_a - 1, high_b - 1
    places: dict[str, list[int]] = {}
    for j in range(high_b - 1, low - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list = []
    for i in range(low, high_a):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[:2])
        link = link[2]
    tail = len(a) - high_a
    return ([(i, i) for i in range(low)] + middle[::-1] + [(high_a + i, high_b + i) for i in range(tail)])


def main_text(own: list[tuple[str, bool]], other: list[tuple[str, bool]] | None) -> str:
    """Lines of a page without those it shares with its neighbour."""
    kept = [True] * len(own)
    if other:
        for i, j in common([x[0] for x in own], [x[0] for x in other]):
            kept[i] = own[i][1] and other[j][1]
    if any(inside for _, inside in own):
        kept = [k and inside for k, (_, inside) in zip(kept, own, strict=True)]
    return " ".join(t for k, (t, _) in zip(kept, own, strict=True) if k)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?([^/?#]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"(?:/|/index\.html?|\.html?)$", "")


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


KEY = ("host", "path", "page_id", "digest")


def edges(keys: DataFrame, buckets: int, scratch: Scratch) -> tuple[list, list]:
    """Bounds that cut the pages, in the order of ``KEY``, into equal buckets, and
    the pages beyond its edges that a bucket needs: ``(*KEY, bucket)`` of one page
    of the run (adjacent pages with one host and html) before that of its first
    page, and of the run after that of its last, if on the same host. All lists
    have a few rows per bucket, whatever the number of pages."""
    own = scratch.write(ordered_index(keys, list(KEY), scratch), "order")
    n = own.count()
    at = lambda places: {r["idx"]: r for r in own.where(F.col("idx").isin(list(places))).collect()} if places else {}
    found = at({n * k // buckets for k in range(1, buckets)} if n else set())
    bounds = [tuple(found[i][c] for c in KEY) for i in sorted(found)]
    bounds = list(dict.fromkeys(bounds))
    before = own.select((F.col("idx") + 1).alias("idx"), F.col("host").alias("h"), F.col("digest").alias("d"))
    head = F.col("h").isNull() | (F.col("h") != F.col("host")) | (F.col("d") != F.col("digest"))
    heads = own.join(before, "idx", "left").withColumn("head", F.when(head, F.col("idx")))
    spans = sorted(heads.groupBy(bucket_of(bounds, keys).alias("b")).agg(
        F.min("idx").alias("first"), F.max("idx").alias("last"), F.min("head").alias("low"), F.max("head").alias("high")).collect())
    near, latest = [], None  # (bucket, own place, place beyond)
    for s in spans:
        start = s["first"] if s["low"] == s["first"] else latest
        if start:
            near.append((s["b"], s["first"], start - 1))
        latest = latest if s["high"] is None else s["high"]
    later = None
    for s in reversed(spans):
        if later is not None:
            near.append((s["b"], s["last"], later))
        later = later if s["low"] is None else s["low"]
    rows = at({i for _, *two in near for i in two})
    return bounds, [(*(rows[j][c] for c in KEY), b) for b, i, j in near if rows[i]["host"] == rows[j]["host"]]


def bucket_of(bounds: list, keys: DataFrame) -> Column:
    if not bounds:
        return F.lit(0)
    kinds = {f.name: f.dataType for f in keys.schema}
    known = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(KEY, x, strict=True)]) for x in bounds])
    own = F.struct(*[F.col(c) for c in KEY])
    return F.size(F.filter(known, lambda x: x <= own))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    Null or empty html gives an empty text; a null url is a host of its own
    name; adjacent pages with the same html are one page for pairing, so copies do
    not delete each other; a page whose host has no other html is settled by
    structure alone; repeated rows come back as often as they came; other columns
    are not read. Partners follow from the order of (host, path, page_id, html)
    alone, not from partitions: its keys are ordered first, and one shuffle of
    the pages deals that order out in equal buckets, which split a hot host, with
    the neighbours beyond the edges of each bucket. Pages are paired while
    streaming; a task holds three parsed pages and spools the ids of long runs.
    """
    import pyarrow as pa

    def run(batches):
        import pickle
        import tempfile
        before = now = None  # groups of adjacent rows with the same host and html
        bucket = None
        out: list[tuple] = []

        def finish(group, after):
            host, path, _, parsed, rows, spool = group
            if not rows and not spool:
                return
            near = [g for g in (after, before) if g and g[0] == host]
            other = max(near, key=lambda g: _alike(path, g[1]))[3] if near else None
            text = main_text(parsed, other)
            if spool:
                spool.seek(0)
                left = spool.held
                while left:
                    ids = pickle.load(spool)
                    left -= len(ids)
                    yield _rows(pa, [(*r, text, len(text)) for r in ids], page_type)
                spool.close()
            out.extend((*r, text, len(text)) for r in rows)

        for batch in batches:
            for b, host, path, page_id, url, html, beyond in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                html = html or ""
                if b != bucket:
                    if now:
                        yield from finish(now, None)
                    before, now, bucket = None, None, b
                if not (now and now[0] == host and now[2] == html):
                    group = [host, path, html, lines(html), [], None]
                    if now:
                        yield from finish(now, group)
                        before = now
                    now = group
                if not beyond:
                    now[4].append((page_id, url))
                    if len(now[4]) >= SPOOLED:  # a long run of copies
                        now[5] = now[5] or _Spool(tempfile.TemporaryFile())
                        now[5].put(pickle.dumps(now[4]), len(now[4]))
                        now[4] = []
            if out:
                yield _rows(pa, out, page_type)
                out.clear()
        if now:
            yield from finish(now, None)
        if out:
            yield _rows(pa, out, page_type)

    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    kind = pages.schema[id_col].dataType.simpleString()
    page_type = pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()
    keyed = pages.select(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
                         F.col(id_col).alias("page_id"), F.xxhash64(F.coalesce(html_col, F.lit(""))).alias("digest"),
                         F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, near = edges(scratch.write(keyed.select(*KEY), "keys"), buckets, scratch)
    # Numbers whose hash partition is the bucket: each bucket has a task of its own.
    free = (spark.range(64 * buckets).select(F.col("id").cast("int").alias("id")).groupBy(
        F.expr(f"pmod(hash(id), {buckets})").alias("p")).agg(F.min("id").alias("id")).orderBy("p").collect())
    deal = F.array(*[F.lit(r["id"]) for r in free])
    keyed = keyed.withColumn("bucket", bucket_of(bounds, keyed))
    if near:  # a few rows per bucket: a proven bound for the broadcast
        fields = ", ".join(f"k_{f.name} {f.dataType.simpleString()}" for f in keyed.select(*KEY).schema)
        beyond = spark.createDataFrame(near, f"{fields}, target int").groupBy(*[f"k_{c}" for c in KEY]).agg(
            F.collect_list(F.struct(F.col("target").alias("bucket"), F.lit(True).alias("beyond"))).alias("targets"))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in KEY])
        joined = keyed.join(F.broadcast(beyond), same, "left")
        here = F.array(F.struct("bucket", F.lit(False).alias("beyond")))
        keyed = joined.withColumn("to", F.explode(F.when(F.col("targets").isNull(), here).otherwise(F.concat(here, "targets"))))
        keyed = keyed.select(*KEY, "url", "html", "to.bucket", "to.beyond")
    else:
        keyed = keyed.withColumn("beyond", F.lit(False))
    # Rows before the bucket's own sort first, rows behind it last, by their keys.
    dealt = (keyed.withColumn("deal", deal[F.col("bucket") % len(free)]).repartition(buckets, "deal")
             .sortWithinPartitions("bucket", *KEY))
    return dealt.select("bucket", "host", "path", "page_id", "url", "html", "beyond").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars bigint")


class _Spool:
    """Pickled lists in a temporary file, and how many rows they hold."""

    def __init__(self, file):
        self.file, self.held = file, 0

    def put(self, data: bytes, rows: int) -> None:
        self.file.write(data)
        self.held += rows

    def __getattr__(self, name):
        return getattr(self.file, name)


def _rows(pa, out, page_type):
    ids, urls, texts, sizes = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, page_type), pa.array(urls, pa.string()),
                                       pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
                                      ["page_id", "url", "text", "n_chars"])
