r"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Text is turned into a template: names, numbers and units become typed
placeholders, the rest lower-cased words. Windows of ``W`` template words of the
benchmark items are hash-joined with those of all documents, so a question asked
again with other numbers or names still meets its item. A pair is reported if
the document holds at least ``COVER`` of the item's windows and its slots are
consistent: each value of the item stands for one and the same value in the
document in at least ``CONSISTENT`` of the places where they meet. Both are judged
for the whole document and for each occurrence of the item in it - windows that
lie on one diagonal (place in the document minus place in the item), or on
neighbouring ones - and one that passes is enough, so a second copy with other
values never hides the first. Names are told apart by their value, numbers and
units also by the word that follows them (3 apples, 3 days).

A run of ``RUN`` or more words of an item on one diagonal, with consistent slots,
counts whatever its share of the item. Documents and items have three templates:

* plain: the slots below;
* literal: no names (a lower-cased copy of an item with names meets it here; it
  must hold ``COVER`` of the windows with names, too);
* loose: every capitalised word is a name, also at a sentence start or behind a
  digit, quote or bracket, and number words are numbers.

Slots of the plain template:

* name: a capitalised word behind a lower-case letter, comma or semicolon and a
  space (so not the first word of a sentence);
* number: digits with inner points or commas, not part of a word;
* unit: a unit word or sign right behind a number, or a currency sign before it.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

W = 5
COVER = 0.6
RUN = 24                 # words of an item in a row that are a passage of it
CONSISTENT = 0.8
WHOLE = "whole"
MIN_LINE = -2 ** 31       # below every diagonal
GROUP = ["doc_id", "item_id", "form", "kind", "of", "key", "run"]
FORMS = ("plain", "literal", "loose")
LITERALS = 2             # words that are no placeholders, in a window that counts
BROADCAST_WINDOWS = 400_000  # rows of one 8-byte hash; beyond it the join shuffles

# Private-use characters that mark the placeholder types, and units.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = ("mm cm dm m km in ft yd mi g kg mg lb oz t l ml dl s sec secs ms min mins h hr hrs hour hours minute minutes "
         "second seconds day days week weeks month months year years kmh mph hz khz mhz ghz w kw mwh kwh v a b kb mb gb tb "
         "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms litre litres "
         "liter liters mile miles foot feet inch inches pound pounds dollar dollars euro euros cent cents percent degree degrees")
SIGNS = "$€£¥%°"
MARKS = "\ue000-\ue002"
# The first letter or digit is tested before what stands to its left, so the
# scan passes over other characters with one class test.
_NAMES = r"(\p{Lu})(?<=[\p{Ll},;] \p{Lu})(\p{Ll}+)"
_VALUE = r"(\d(?<![\p{L}\p{N}]\d)\d*(?:[.,]\d+)*)"
_CAPITAL = r"(?<![\p{L}\p{N}\ue000])(\p{Lu}[\p{Ll}\p{M}]+)"
# Number words without the articles among them, four languages.
TENS = ("twenty thirty forty fifty sixty seventy eighty ninety vingt trente quarante cinquante soixante veinte treinta "
        "cuarenta cincuenta sesenta setenta ochenta noventa zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig")
ONES = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
        "nineteen hundred thousand million deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize "
        "cent mille zwei drei vier fünf sechs sieben acht neun zehn elf zwölf hundert tausend dos tres cuatro cinco seis siete "
        "ocho nueve diez once doce trece catorce quince cien ciento mil")
_ONE, _TEN = ("|".join(sorted(w.split(), key=len, reverse=True)) for w in (ONES, TENS))
_COMPOUND = rf"(?i)(?<![\p{{L}}\p{{N}}])({_TEN})[ -]({_ONE})(?![\p{{L}}\p{{N}}])"
_WORD_NUMBER = rf"(?i)(?<![\p{{L}}\p{{N}}])((?:{_TEN})(?:{_ONE})?|{_ONE})(?![\p{{L}}\p{{N}}])"
_UNITS = _VALUE + r"[ -]?((?:" + "|".join(sorted(UNITS.split(), key=len, reverse=True)) + r")(?![\p{L}\p{N}])|[%°])"
_MONEY = r"([$€£¥]) ?(?=\d)"
_WORD_UNITS = (_WORD_NUMBER + r"[ -]((?:" + "|".join(sorted(UNITS.split(), key=len, reverse=True)) + r")(?![\p{L}\p{N}])|[%°])")
_NUMBERS = _VALUE + r"(?![\p{L}\p{N}])"
_SLOT = rf"([{MARKS}])[\p{{L}}\p{{N}}{SIGNS}]*(?:[.,]\d+)*"
_BETWEEN = rf"[^\p{{L}}\p{{N}}{MARKS}]+"
# The same cuts while slots still hold their values: a point or comma inside a
# number is no cut, and neither is a sign behind a mark.
_BETWEEN_VALUES = rf"(?:[^\p{{L}}\p{{N}}{MARKS}{SIGNS}.,]|[.,](?!\d)|(?<!\d)[.,]|(?<!{UNIT})[{SIGNS}])+"


def marked(text: Column, form: str = "plain") -> Column:
    """Lower-cased text in which every slot value follows its type's mark."""
    t = F.coalesce(text, F.lit(""))
    if form == "plain":
        t = F.regexp_replace(t, _NAMES, f"{NAME}$1$2")
    if form == "loose":
        t = F.regexp_replace(t, _COMPOUND, "$1$2")
        t = F.regexp_replace(t, _WORD_UNITS, f"{NUMBER}$1 {UNIT}$2 ")
        t = F.regexp_replace(t, _WORD_NUMBER, f"{NUMBER}$1")
        t = F.regexp_replace(t, _CAPITAL, f"{NAME}$1")
    t = F.regexp_replace(F.lower(t), _MONEY, f" {UNIT}$1 ")
    t = F.regexp_replace(t, _UNITS, f"{NUMBER}$1 {UNIT}$2 ")
    return F.regexp_replace(t, _NUMBERS, f"{NUMBER}$1")


def template_words(text: Column, form: str = "plain") -> Column:
    """Words of the template; slots are their mark alone."""
    return F.array_remove(F.split(F.regexp_replace(marked(text, form), _SLOT, " $1 "), _BETWEEN), "")


def valued_words(text: Column, form: str = "plain") -> Column:
    """The same words, slots with their values."""
    return F.array_remove(F.split(marked(text, form), _BETWEEN_VALUES), "")


def is_slot(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(NAME, NUMBER, UNIT)


def _windows(words: str, lengths: list[int]) -> Column:
    """Array of ``(pos, hash)``-ready hashes: one array per window length."""
    def of(n: int) -> Column:
        own = lambda i: F.xxhash64(F.lit(n), *[F.col(words)[i + k] for k in range(n)])
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), own)).otherwise(
            F.array().cast("array<bigint>"))
    return of(lengths[0]) if len(lengths) == 1 else F.concat(*[of(n) for n in lengths])


def item_windows(items: DataFrame, scratch: Scratch, w: int) -> DataFrame:
    """``(item_id, form, pos, rank, n, length, hash, slots, next, named)`` of the windows
    that count: those with ``LITERALS`` words outside slots, or all if the plain
    template of an item has none of these. ``rank`` is their place among these.
    An item of fewer than ``w`` words is one window. The literal and the loose
    template count where they differ from the plain one; the loose one needs
    ``COVER`` of its windows to count, as slots alone say nothing. ``named``
    windows hold a name of the plain template literally."""
    words = items.select("item_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("form"), template_words(F.col("text"), f).alias("words"), valued_words(F.col("text"), f).alias("values"))
        for f in FORMS])).alias("f"), template_words(F.col("text")).alias("plain"))
    words = words.select("item_id", "f.*", "plain").where((F.col("form") == FORMS[0]) | (F.col("words") != F.col("plain")))
    words = words.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(w)))
    words = words.withColumn("next", F.expr("concat(slice(values, 2, size(values)), array(''))"))
    hashes = F.expr("transform(sequence(0, size(words) - n), i -> struct(i as pos, slice(words, i + 1, n) as w, "
                    "slice(values, i + 1, n) as v, slice(next, i + 1, n) as next, slice(plain, i + 1, n) as p))")
    flat = words.select("item_id", "form", "n", F.size("words").alias("length"), F.explode(hashes).alias("x")).select(
        "item_id", "form", "n", "length", "x.pos", "x.w", "x.v", "x.next", "x.p")
    hash_of = F.coalesce(*[F.when(F.col("n") == k, F.xxhash64(F.lit(k), *[F.col("w")[j] for j in range(k)])) for k in range(1, w + 1)])
    slots = F.transform("v", lambda x: F.when(is_slot(x), x))
    flat = flat.select("item_id", "form", "pos", "n", "length", hash_of.alias("hash"), slots.alias("slots"), "next",
                       ((F.col("form") == "literal") & F.array_contains("p", NAME)).alias("named"),
                       F.transform("w", lambda x: F.when(~is_slot(x), x)).alias("lits"),
                       (F.size(F.filter("w", lambda x: ~is_slot(x))) >= F.least(F.lit(LITERALS), F.col("n"))).alias("strong"))
    best = flat.groupBy("item_id", "form").agg(F.max("strong").alias("any"), F.avg(F.col("strong").cast("int")).alias("share"))
    own = flat.join(best, ["item_id", "form"]).where("strong = any").where(
        (F.col("form") == FORMS[0]) | F.col("any") & ((F.col("form") != "loose") | (F.col("share") >= COVER)))
    rank = F.row_number().over(Window.partitionBy("item_id", "form").orderBy("pos"))
    return scratch.write(own.withColumn("rank", rank).drop("any", "share", "strong"), "items")


def _bigrams(words: str) -> Column:
    """Hashes of adjacent words."""
    return F.when(F.size(words) >= 2, F.transform(F.sequence(F.lit(0), F.size(words) - 2),
                                                  lambda i: F.xxhash64(F.col(words)[i], F.col(words)[i + 1]))).otherwise(F.array().cast("array<bigint>"))


def candidates(docs: DataFrame, own: DataFrame, scratch: Scratch, w: int, cover: float) -> DataFrame | None:
    """Ids of the documents that may hold an item, or None if that cannot be told
    without their templates.

    Adjacent words that no template masks are adjacent in the lower-cased text, too.
    A document with ``cover`` of an item's windows lacks at most the rest, so it
    holds one of any larger set of them; a run of ``RUN`` words holds a whole block of
    half as many windows. Of the windows those are taken whose rarest pair of adjacent
    unmasked words is in the fewest documents, and these pairs are the anchors. A
    window without such a pair comes last; if one has to be taken, every
    document is looked at."""
    pairs = F.expr("filter(transform(sequence(0, greatest(size(lits) - 2, 0)), i -> if(get(lits, i) is null or get(lits, i + 1) is null, "
                   "null, xxhash64(get(lits, i), get(lits, i + 1)))), x -> x is not null)")
    windows = own.select("item_id", "form", "rank", "hash", pairs.alias("pairs"))
    known = windows.select(F.explode("pairs").alias("pair")).distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known
    words = docs.select("doc_id", F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+"), "").alias("words"))
    seen = scratch.write(words.select("doc_id", F.explode(F.array_distinct(_bigrams("words"))).alias("pair")).join(known, "pair"), "pairs_seen")
    often = seen.groupBy("pair").agg(F.count(F.lit(1)).alias("df"))
    # The rarest pair of every window; a pair in no document is the best anchor of all.
    rare = (windows.select("item_id", "form", "rank", "hash", F.explode_outer("pairs").alias("pair")).join(often, "pair", "left")
            .groupBy("item_id", "form", "hash").agg(F.min("rank").alias("rank"), F.min(F.struct(
                F.when(F.col("pair").isNull(), F.lit(2 ** 62)).otherwise(F.coalesce("df", F.lit(0))).alias("df"), "pair")).alias("best")))
    item = Window.partitionBy("item_id", "form")
    place = F.row_number().over(item.orderBy("best", "hash"))
    need = F.floor((1 - cover) * F.count(F.lit(1)).over(item) + 1e-9) + 1
    # Every window by its rank, for the runs: hashes that repeat have several ranks.
    block = Window.partitionBy("item_id", "form", F.floor(F.col("rank") / max(1, (RUN - w + 2) // 2))).orderBy("best", "hash")
    ranked = windows.select("item_id", "form", "rank", "hash").join(rare.select("item_id", "form", "hash", "best"), ["item_id", "form", "hash"])
    long = ranked.withColumn("longest", F.max("rank").over(item)).where(F.col("longest") >= RUN - w)
    taken = scratch.write(rare.withColumn("place", place).withColumn("need", need).where("place <= need").select("best")
                          .unionByName(long.withColumn("first", F.row_number().over(block)).where("first = 1").select("best")), "anchors")
    if not taken.where("best.pair is null").isEmpty():
        return None
    anchors = taken.select("best.pair").distinct()
    return scratch.write(seen.join(anchors, "pair", "left_semi").select("doc_id").distinct(), "candidates")


def occurrences(meet: DataFrame) -> DataFrame:
    """Rows of ``meet`` once for each group they are judged in: the whole
    document, their diagonal, their run of windows on it, and their run of
    neighbouring diagonals (at most a quarter of the item apart, so other names
    of more words, or a few words put in, do not split an occurrence). Windows
    hold what one document and one template of an item share."""
    pair = ["doc_id", "copy", "item_id", "form"]
    meet = meet.withColumn("line", F.col("at") - F.col("pos"))
    gap = F.col("line") - F.lag("line").over(Window.partitionBy(*pair).orderBy("line"))
    meet = meet.withColumn("first", F.when(gap > F.greatest(F.lit(2), F.floor(F.col("length") / 4)), F.col("line")))
    near = F.coalesce(F.max("first").over(Window.partitionBy(*pair).orderBy("line")), F.lit(MIN_LINE))
    run = F.col("rank") - F.row_number().over(Window.partitionBy(*pair, "line").orderBy("rank"))
    meet = meet.withColumn("near", near).withColumn("run", run)
    group = lambda kind, of, key, run: F.struct(F.lit(kind).alias("kind"), of.alias("of"), key.alias("key"), run.alias("run"))
    copy, zero = F.col("copy"), F.lit(0)
    kinds = F.array(group(WHOLE, zero.cast("bigint"), zero, zero), group("line", copy, F.col("line"), zero),
                    group("run", copy, F.col("line"), F.col("run")), group("near", copy, F.col("near"), zero))
    return (meet.select("doc_id", "item_id", "form", "n", "hash", "rank", "slots", "next", "named", "v", F.explode(kinds).alias("g"))
            .select("doc_id", "item_id", "form", "g.*", "n", "hash", "rank", "slots", "next", "named", "v"))


def consistency(groups: DataFrame) -> DataFrame:
    """Share of a group's slots that stand for one and the same value: over all
    slots by value, or the lesser of that of names and that of numbers and units
    by value and following word, whichever is greater."""
    value = groups.drop("rank").distinct().select(*GROUP, F.explode(F.arrays_zip("slots", "next", "v")).alias("z")).where("z.slots is not null")
    value = value.select(*GROUP, F.col("z.slots").alias("slot"), F.col("z.next").alias("next"), F.col("z.v").alias("value"))
    name = F.substring("slot", 1, 1) == NAME
    roles = F.array(F.struct(F.lit("all").alias("part"), F.lit("").alias("role")),
                    F.struct(F.when(name, "names").otherwise("numbers").alias("part"),
                             F.when(name, "").otherwise(F.col("next")).alias("role")))
    each = value.withColumn("r", F.explode(roles)).groupBy(*GROUP, "r.part", "slot", "r.role", "value").agg(F.count(F.lit(1)).alias("c"))
    most = each.groupBy(*GROUP, "part", "slot", "role").agg(F.max("c").alias("m"), F.sum("c").alias("c"))
    share = most.groupBy(*GROUP, "part").agg((F.sum("m") / F.sum("c")).alias("share"))
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("share")))
    return share.groupBy(*GROUP).agg(F.greatest(of("all"), F.least(of("names"), of("numbers"))).alias("consistency"))


def contaminated(docs: DataFrame, items: DataFrame, w: int = W, cover: float = COVER, consistent: float = CONSISTENT,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, windows, coverage, consistency)`` of contaminated pairs.

    ``coverage`` is the share of the item's distinct windows in the document (or,
    if only an occurrence passes, in that; less than ``cover`` if it is a run of
    ``RUN`` words), ``consistency`` 1.0 for pairs without slots. Null, empty or word-less texts
    and items match nothing; an item of fewer than ``w`` words must occur as a
    whole; rows that repeat an id count as one document; a null id is one
    document of its own; empty tables give an empty result; other columns are
    not read.

    Texts are read, not shuffled. A first pass looks at pairs of adjacent words only
    (``candidates``); documents without an anchor of any item cannot match and are
    not turned into templates. Of the others, window hashes meet the items' hashes in a
    broadcast join while those are at most ``BROADCAST_WINDOWS`` (their number
    is checked; beyond it the join shuffles hashes). Texts are read again for
    documents that may hold an item or a passage of it.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = item_windows(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), scratch, w)
    facts = own.agg(F.collect_set("n").alias("n"), F.count_distinct("hash").alias("c")).first()
    lengths = sorted(facts["n"]) or [w]
    maybe = candidates(docs, own, scratch, w, cover)
    if maybe is not None:
        docs = docs.join(maybe.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    own = own.drop("lits")
    hashes = own.select("hash").distinct()
    hashes = F.broadcast(hashes) if facts["c"] <= BROADCAST_WINDOWS else hashes

    found = docs.select("doc_id", *[template_words(F.col("text"), f).alias(f) for f in FORMS])
    found = found.select("doc_id", F.explode(F.concat(_windows(FORMS[0], lengths), *[
        F.when(F.col(f) == F.col(FORMS[0]), F.array().cast("array<bigint>")).otherwise(_windows(f, lengths))
        for f in FORMS[1:]])).alias("hash"))
    met = scratch.write(found.join(hashes, "hash").distinct(), "met")
    total = own.groupBy("item_id", "form").agg(F.count_distinct("hash").alias("total"), F.count_distinct(F.when(F.col("named"), F.col("hash"))).alias("names"))
    # A run has as many places of the item as its windows.
    pairs = (met.join(own.select("item_id", "form", "hash", "rank"), "hash").groupBy("doc_id", "item_id", "form")
             .agg(F.count_distinct("hash").alias("windows"), F.count_distinct("rank").alias("places"))
             .join(total, ["item_id", "form"]).withColumn("coverage", F.col("windows") / F.col("total"))
             .where((F.col("coverage") >= cover) | (F.col("places") >= RUN - w + 1)))
    pairs = scratch.write(pairs.select("doc_id", "item_id", "form"), "pairs")

    # Slots: the windows of a pair that meet, with their places and the values on either side.
    held = docs.join(pairs.select("doc_id").distinct(), docs["doc_id"].eqNullSafe(pairs["doc_id"]), "left_semi")
    held = held.select("doc_id", F.xxhash64("text").alias("copy"), F.explode(F.array(*[
        F.struct(template_words(F.col("text"), f).alias("words"), valued_words(F.col("text"), f).alias("values"))
        for f in FORMS])).alias("f")).select("doc_id", "copy", "f.*").distinct()
    parts = [F.expr(f"transform(sequence(0, size(words) - {n}), i -> struct(i as pos, slice(values, i + 1, {n}) as v))")
             for n in lengths]
    parts = [F.when(F.size("words") >= n, p) for n, p in zip(lengths, parts, strict=True)]
    spots = held.withColumn("h", _windows("words", lengths)).withColumn(
        "x", F.flatten(F.array_compact(F.array(*parts)))).select("doc_id", "copy", F.explode(F.arrays_zip("h", "x")).alias("z"))
    spots = spots.select("doc_id", "copy", F.col("z.h").alias("hash"), F.col("z.x.pos").alias("at"), F.col("z.x.v").alias("v"))
    # Only windows that some item has are shuffled.
    meet = (spots.join(hashes, "hash", "left_semi").join(own, "hash")
            .join(pairs.select(F.col("doc_id").alias("d"), F.col("item_id").alias("t"), F.col("form").alias("f")),
                  F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("item_id") == F.col("t")) & (F.col("form") == F.col("f")),
                  "left_semi"))
    # Templates of a document that agree in a window give it once.
    meet = meet.dropDuplicates(["doc_id", "copy", "item_id", "form", "pos", "at"])
    groups = scratch.write(occurrences(meet), "groups")
    covered = groups.groupBy(*GROUP).agg(F.count_distinct("hash").alias("windows"), F.count_distinct(F.when(F.col("named"), F.col("hash"))).alias("named"),
                                         (F.count(F.lit(1)) + F.max("n") - 1).alias("words")).join(total, ["item_id", "form"])
    shares = consistency(groups)
    g, s = covered.alias("g"), shares.alias("s")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in GROUP]
    judged = g.join(s, reduce(and_, same), "left").select(
        "g.doc_id", "g.item_id", "g.kind", (F.col("windows") / F.col("total")).alias("coverage"), "windows",
        (F.col("named") >= cover * F.col("names")).alias("named"), ((F.col("g.kind") == "run") & (F.col("words") >= RUN)).alias("passage"),
        F.coalesce("consistency", F.lit(1.0)).alias("consistency"))
    judged = judged.where(((F.col("coverage") >= cover) & F.col("named") | F.col("passage")) & (F.col("consistency") >= consistent))
    # Whole document first, then the occurrence that covers most.
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        (F.col("kind") == WHOLE).alias("whole"), "coverage", "consistency", "windows")).alias("b"))
    return best.select("doc_id", "item_id", "b.windows", "b.coverage", "b.consistency")
