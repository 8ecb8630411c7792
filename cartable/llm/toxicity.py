"""Toxicity of whole texts: a learned lexicon, misspellings by Levenshtein
automata over its trie, and context windows that tell quotation from abuse.

* **Lexicon.** Terms are word starts of ``STEMS`` letters and whole words of two
  letters or more (``word$``). A term enters if toxic training documents hold it far more often
  than clean ones, in about as many different neighbourhoods as documents
  (copies of one text have one neighbourhood, so their rare words stay out).
  Counts cover every labelled training row; the rows are written once, terms
  are counted in the toxic ones first, and only terms that a share of these
  hold are then counted in the clean ones.
* **Automaton.** The states of the Levenshtein automaton of a token - one bit
  mask of matched token positions per number of errors - are stepped along the
  edges of the lexicon trie; a branch ends when no state is left. The trie holds
  every whole word that allows errors, and the longest starts that many words
  share, which accept whatever follows. A piece with digits or signs between its
  letters is tried as a whole, too. Tokens are
  tried only if they hold a part of some term about where the term has it (e
  errors leave one of e + 1 parts intact), which one Aho-Corasick pass over the
  token tells; results are kept in a bounded cache.
* **Trust.** A word near a term that two clean texts hold is a word of its own,
  no misspelling. Words that only one holds tell how often an unknown one is yet to
  come (Good-Turing): a term is searched with errors only if the share of toxic
  documents that hold it, times ``TYPOS``, exceeds that rate by ``MIN_NEAR_ODDS``.
* **Context.** A hit is weighed by its window of ``WINDOW`` tokens: inside
  quotation marks or near a reporting word it counts as quotation, near a word
  of address as abuse.
* **Score.** Logistic regression over six sums of hits, fitted on at most
  ``FIT_ROWS`` labelled rows (bounded sample of smallest id hashes), which also
  tell the trusted terms and the known words. Exact and misspelled hits of a term share its weight,
  times ``DISCOUNT`` for each error, so the regression learns contexts only; toxic
  rows are fitted a second time with one slip in each hit.
"""
from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TwoAgeCache
from .common import Scratch, slices

STEMS = (4, 5, 6)
WHOLE_MIN = 2            # letters of the shortest word that is a term
MIN_CONTEXTS = 5
CONTEXTS_KEPT = 20       # smallest neighbourhood hashes a task keeps of a term
VARIED = 0.5             # different neighbourhoods of a term, per document that holds it
PRODUCTIVE = 3           # words of the lexicon with one start: the start is searched with errors, too
MIN_SUPPORT = (5, 0.005)  # documents, and share of the toxic documents
MIN_LOG_ODDS = 3.0
WINDOW = 5
FIT_ROWS = 20_000
THRESHOLD = 0.7
FLUSH = 100_000          # terms a task holds before it hands on its counts
PIECES_KEPT = 100_000    # pieces in each age of a task's cache
FEATURES = 6
DISCOUNT = 0.8           # factor of a hit's weight for each error
TYPOS = 0.1              # assumed share of a term's uses that are misspelled
MIN_NEAR_ODDS = 1.0
# Words that report speech and words of address, four languages.
REPORTING = frozenset("said says say wrote writes called calls quoted quote reported according "
                      "dit écrit appelé selon sagte sagt schrieb nannte laut dijo dice escribió llamó según".split())
ADDRESS = frozenset("you your yourself tu toi vous votre du dich dir ihr euch tú usted ustedes vosotros".split())
OPENING, CLOSING = "\"“„«‘'([", "\"”“»’'])"
EDGES = OPENING + CLOSING + ".,;:!?…-_*/"
_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """Lexicon terms a word can hold: its starts, and itself."""
    out = [word[:k] for k in STEMS if len(word) >= k]
    if len(word) >= WHOLE_MIN:
        out.append(word + "$")
    return out


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic)`` of labelled rows outside the held-out third; an id
    labelled more than once is toxic if one of its labels says so."""
    own = labels.where("doc_id is not null and toxic is not null")
    return own.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def toxic_terms(rows: DataFrame) -> DataFrame:
    """Partial counts ``(term, docs, context)`` of the toxic texts in ``rows``:
    documents that hold the term, or one neighbourhood of it. A task keeps the
    ``CONTEXTS_KEPT`` smallest neighbourhoods of a term, so the distinct ones
    over all tasks are exact up to that number and reach it if there are more."""
    import pyarrow as pa

    def run(batches):
        docs: dict[str, int] = {}
        contexts: dict[str, set] = {}

        def flush():
            terms, counts, hashes = list(docs), list(docs.values()), [None] * len(docs)
            for t, c in contexts.items():
                terms += [t] * len(c)
                counts += [0] * len(c)
                hashes += c
            docs.clear()
            contexts.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64()),
                                               pa.array(hashes, pa.int64())], ["term", "docs", "context"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                words = _LETTERS.findall((text or "").lower())
                for t in {t for w in set(words) for t in terms_of(w)}:
                    docs[t] = docs.get(t, 0) + 1
                for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    h = hash_of(f"{before} {after}")
                    for t in terms_of(w):
                        c = contexts.setdefault(t, set())
                        c.add(h)
                        if len(c) > CONTEXTS_KEPT:
                            c.discard(max(c))
                if len(contexts) > FLUSH:
                    yield flush()
        yield flush()

    return rows.where("toxic = 1").select("text").mapInArrow(run, "term string, docs bigint, context bigint")


def clean_counts(rows: DataFrame, terms: set[str]) -> DataFrame:
    """Partial counts ``(term, docs)`` of these terms in the clean texts."""
    import pyarrow as pa

    def run(batches):
        found = TwoAgeCache(lambda w: [t for t in terms_of(w) if t in terms], PIECES_KEPT)
        docs: dict[str, int] = {}
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                words = set(_LETTERS.findall((text or "").lower()))
                for t in {t for w in words for t in found[w]}:
                    docs[t] = docs.get(t, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64())],
                                         ["term", "docs"])

    return rows.where("toxic = 0").select("text").mapInArrow(run, "term string, docs bigint")


def hash_of(s: str) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(s) >> 1


def learn_lexicon(rows: DataFrame, scratch: Scratch) -> tuple[dict[str, float], dict[str, float], int, int]:
    """``({term: log odds}, {term: share of toxic rows}, toxic rows, clean rows)``. What reaches the driver is
    bounded: a term needs a share ``MIN_SUPPORT`` of the toxic documents, so
    their number is at most the terms of one document over that share."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}, {}, n1, n0
    parts = scratch.write(toxic_terms(rows), "terms")
    least = max(MIN_SUPPORT[0], math.ceil(MIN_SUPPORT[1] * n1))
    held = parts.where("context is null").groupBy("term").agg(F.sum("docs").alias("a")).where(F.col("a") >= least)
    varied = (parts.where("context is not null").select("term", "context").distinct()
              .groupBy("term").agg(F.count(F.lit(1)).alias("c")))
    enough = F.greatest(F.lit(MIN_CONTEXTS), F.least(F.lit(CONTEXTS_KEPT), F.col("a") * VARIED))
    toxic = {r["term"]: r["a"] for r in held.join(varied, "term").where(F.col("c") >= enough).collect()}
    scratch.drop(parts)
    clean = {r["term"]: r["b"] for r in clean_counts(rows, set(toxic)).groupBy("term").agg(F.sum("docs").alias("b")).collect()}
    odds = {t: math.log((a + 0.5) / (n1 + 1)) - math.log((clean.get(t, 0) + 0.5) / (n0 + 1)) for t, a in toxic.items()}
    return {t: o for t, o in odds.items() if o >= MIN_LOG_ODDS}, {t: a / n1 for t, a in toxic.items()}, n1, n0


class Lexicon:
    """Terms with weights, exact lookup and fuzzy lookup through the trie."""

    def __init__(self, terms: dict[str, float], exact_only: frozenset = frozenset(), known: frozenset = frozenset()):
        import ahocorasick
        self.terms, self.known = terms, known
        self.tries: dict[int, dict] = {}  # one for each number of errors its terms allow
        # Part -> errors -> place in the token -> lengths the token may have, as
        # bits; starts of words allow every length from the least on.
        parts: dict[str, dict[int, dict[int, int]]] = {}
        starts: dict[str, int] = {}
        for term in terms:
            if term.endswith("$"):
                for k in STEMS:
                    if len(term) <= k:
                        break
                    starts[term[:k]] = starts.get(term[:k], 0) + 1
        for term in terms:
            body, errors = term.rstrip("$"), self.errors(term)
            start = not term.endswith("$") and starts.get(term, 0) >= PRODUCTIVE
            if start:
                errors = self.errors(term + "$")
            if not errors or term in exact_only:
                continue
            node = self.tries.setdefault(errors, {})
            for c in body:
                node = node.setdefault(c, {})
            node[not start] = term  # what follows a start is free
            least, most = len(body) - errors, len(body) + errors
            sizes = -1 << least if start else (1 << most + 1) - (1 << least)
            # Of e + 1 parts, e errors leave one intact, moved by e places at most.
            cuts = [len(body) * k // (errors + 1) for k in range(errors + 2)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                places = parts.setdefault(body[at:end], {}).setdefault(errors, {})
                for i in range(max(0, at - errors), at + errors + 1):
                    places[i] = places.get(i, 0) | sizes
        self.parts = ahocorasick.Automaton()
        for part, places in parts.items():
            # Places of the part's last letter, as the automaton reports these.
            self.parts.add_word(part, [(e, {i + len(part) - 1: z for i, z in p.items()}) for e, p in places.items()])
        self.parts.make_automaton()
        self.any = bool(parts)
        self.cache = TwoAgeCache(self._find, PIECES_KEPT)

    @staticmethod
    def errors(term: str) -> int:
        """Errors a whole-word term allows; starts of words allow none, as any
        longer word could hold one by chance, unless many words share them."""
        if not term.endswith("$"):
            return 0
        return 0 if len(term) < 6 else 1 if len(term) < 10 else 2

    def find(self, piece: str) -> tuple[float, int] | None:
        """``(weight, errors)`` of the best term in a white-space piece, or None;
        each error takes its share of the term's weight."""
        return self.cache[piece]

    def _find(self, piece: str) -> tuple[float, int] | None:
        best = None
        for word in (piece,) if piece.isalpha() else _LETTERS.findall(piece):
            exact = [self.terms[t] for t in terms_of(word) if t in self.terms]
            hit = (max(exact), 0) if exact else self.fuzzy(word)
            if hit and (best is None or (hit[1] == 0, hit[0]) > (best[1] == 0, best[0])):
                best = hit
        if best is None and not piece.isalpha() and not (core := piece.strip(EDGES)).isalpha():
            best = self.fuzzy(core)  # digits or signs between the letters
        return best and (best[0] * DISCOUNT ** best[1], best[1])

    def _worth_trying(self, word: str) -> set[int]:
        """Numbers of errors whose tries may hold the word."""
        size, out = len(word), set()
        if self.any:
            for end, places in self.parts.iter(word):
                for errors, at in places:
                    if end in at and at[end] >> size & 1:
                        out.add(errors)
        return out

    def near(self, word: str) -> dict[str, int]:
        """Terms within their allowed errors of a word, and these errors: trie
        walks of the automaton. A known word is no misspelling."""
        found: dict[str, int] = {}
        where: dict[str, int] = {}
        if word in self.known:
            return found
        for errors in self._worth_trying(word):
            if not where:
                for i, c in enumerate(word):
                    where[c] = where.get(c, 0) | 1 << i
            self._walk(self.tries[errors], errors, where, len(word), found)
        return found

    def near_in(self, piece: str) -> dict[str, list[str]]:
        """Words of a white-space piece that are near terms, with these, unless
        the piece holds a term as it is."""
        words = _LETTERS.findall(piece)
        if any(t in self.terms for w in words for t in terms_of(w)):
            return {}
        return {w: list(n) for w in {*words, piece.strip(EDGES)} if (n := self.near(w))}

    def fuzzy(self, word: str) -> tuple[float, int] | None:
        """``(weight, errors)`` of the best term within its allowed errors."""
        found = self.near(word)
        if not found:
            return None
        least = min(found.values())
        return max(self.terms[t] for t, e in found.items() if e == least), least

    @staticmethod
    def _walk(trie: dict, errors: int, where: dict[str, int], size: int, found: dict[str, int]) -> None:
        full, end = (1 << size + 1) - 1, 1 << size
        stack = [(trie, [(2 << e) - 1 for e in range(errors + 1)])]  # e errors may skip the first e characters of the token
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c is True or c is False:
                    accepted = end if c else full  # behind a start any place will do
                    e = next((e for e in range(errors + 1) if state[e] & accepted), None)
                    if e is not None:
                        found[child] = e
                    continue
                m = where.get(c, 0)
                last = (state[0] & m) << 1 & full
                new = [last]
                for e in range(1, errors + 1):
                    before = state[e - 1]
                    last = ((state[e] & m) << 1 | before | before << 1 | last << 1) & full
                    new.append(last)
                if last:
                    stack.append((child, new))

    def features(self, text: str | None) -> list[float]:
        """Six sums over the hits of a whole text."""
        return self.sums((text or "").lower().split())

    def sums(self, pieces: list[str]) -> list[float]:
        find = self.cache.__getitem__
        hits = [(i, h) for i, h in enumerate(map(find, pieces)) if h]
        direct = quoted = address = top = certain = 0.0
        for i, (weight, errors) in hits:
            certain += DISCOUNT ** errors
            if self._quoted(pieces, i):
                quoted += weight
            else:
                direct, top = direct + weight, max(top, weight)
            address += any(p.strip(OPENING + CLOSING + ".,;:!?") in ADDRESS for p in pieces[max(0, i - WINDOW):i + WINDOW + 1])
        log = math.log1p
        return [log(direct), top / 10, log(quoted), log(address), min(1.0, 10 * certain / (len(pieces) or 1)), log(certain)]

    def misspelled(self, text: str) -> list[str] | None:
        """Pieces of a text with one slip in each hit, or None if no hit is left."""
        pieces = text.lower().split()
        hits = [i for i, p in enumerate(pieces) if self.cache[p]]
        for i in hits:
            pieces[i] = slip(pieces[i])
        return pieces if any(self.cache[pieces[i]] for i in hits) else None

    @staticmethod
    def _quoted(pieces: list[str], i: int) -> bool:
        before, after = pieces[max(0, i - WINDOW):i + 1], pieces[i:i + WINDOW + 1]
        opened = max((k for k, p in enumerate(before) if p[0] in OPENING), default=-1)
        closed = max((k for k, p in enumerate(before[:-1]) if p.rstrip(".,;:!?")[-1:] in tuple(CLOSING)), default=-1)
        if opened >= 0 and opened >= closed and any(p.rstrip(".,;:!?")[-1:] in tuple(CLOSING) for p in after):
            return True
        return any(p.strip(OPENING + CLOSING + ".,;:!?") in REPORTING for p in before[:-1])


def slip(piece: str) -> str:
    """One letter of a piece changed, dropped, doubled or replaced by a sign; the
    piece itself decides which."""
    h = hash_of(piece)
    places = [i for i, c in enumerate(piece) if c.isalpha()]
    i = places[h // 4 % len(places)]
    c = piece[i]
    new = ("q" if c != "q" else "z", "", c + c, "*")[h % 4]
    return piece[:i] + new + piece[i + 1:]


def fit(x: list[list[float]], y: list[int], l2: float = 1.0, steps: int = 30) -> list[float]:
    """Logistic regression (bias last) by damped Newton steps."""
    import numpy as np
    a = np.hstack([np.array(x, float).reshape(len(y), FEATURES), np.ones((len(y), 1))])
    t, w = np.array(y, float), np.zeros(FEATURES + 1)
    ridge = np.diag([l2] * FEATURES + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - t) + ridge @ w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in w]


class Scorer:
    def __init__(self, lexicon: tuple, weights: list[float]):
        self.lexicon, self.weights = Lexicon(*lexicon), weights

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + sum(w * f for w, f in zip(self.weights, self.lexicon.features(text), strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_sample(rows: DataFrame, n: int, most: int, scratch: Scratch) -> DataFrame:
    """``(text, toxic)`` of at most ``most`` different labelled rows, by the
    smallest hashes of id and text. Rows whose hash is far above the share wanted
    go first, so the texts that are shuffled number about half as many again as
    ``most`` whatever ``n``, and only their hashes are sorted together."""
    wanted = int(2 ** 40 * min(1.0, 1.5 * most / max(n, 1)))
    some = (rows.select("doc_id", "text", "toxic", F.xxhash64("doc_id", "text").alias("h"))
            .where(F.shiftrightunsigned("h", 24) < wanted))
    some = scratch.write(some.distinct().repartition(rows.sparkSession.sparkContext.defaultParallelism, "h"), "sample")
    place = F.shiftrightunsigned("h", 1)
    last = some.select(place.alias("p")).orderBy("p").limit(most).agg(F.max("p")).first()[0]
    out = some.where(place <= last).select("text", "toxic")
    out._scratch_path = some._scratch_path
    return out


def own_words(sample: DataFrame, terms: dict[str, float], shares: dict[str, float],
              scratch: Scratch) -> tuple[frozenset, frozenset]:
    """``(terms not searched with errors, known words)`` by the words near terms
    in the clean texts of the sample. What reaches the driver is bounded by the
    sample: words that two of its texts hold, and one number for each term."""
    import pyarrow as pa

    def run(batches):
        near = TwoAgeCache(Lexicon(terms).near_in, PIECES_KEPT)
        docs: dict[str, int] = {}
        of: dict[str, list[str]] = {}
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                words = {}
                for p in set((text or "").lower().split()):
                    words.update(near[p])
                for w in words:
                    docs[w] = docs.get(w, 0) + 1
                of.update(words)
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()),
                                          pa.array([of[w] for w in docs], pa.list_(pa.string()))], ["word", "docs", "terms"])

    clean = sample.where("toxic = 0").select("text")
    words = scratch.write(clean.mapInArrow(run, "word string, docs bigint, terms array<string>")
                          .groupBy("word").agg(F.sum("docs").alias("n"), F.first("terms").alias("terms")), "near")
    known = frozenset(r["word"] for r in words.where("n > 1").select("word").collect())
    once = {r["term"]: r["n"] for r in words.where("n = 1").select(F.explode("terms").alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    off = exact_only(once, shares, clean.count())
    scratch.drop(words)
    return off, known


def exact_only(once: dict[str, int], shares: dict[str, float], clean: int) -> frozenset:
    """Terms whose misspellings are no evidence: ``once`` counts the words near a
    term that one of ``clean`` texts holds."""
    return frozenset(t for t, n in once.items() if math.log(TYPOS * shares[t] * (clean + 1) / (n + 0.5)) < MIN_NEAR_ODDS)


def train(docs: DataFrame, labels: DataFrame,
          fit_rows: int = FIT_ROWS) -> tuple[tuple[dict[str, float], frozenset, frozenset], list[float]]:
    """Lexicon (terms, those not searched with errors, known words) and weights,
    from the labelled rows that are not held out.

    Without toxic or without clean training rows the lexicon is empty and the
    score is the smoothed share of toxic rows."""
    import pyarrow as pa
    scratch = Scratch(docs.sparkSession, "toxicity")
    own = training_rows(docs, labels)
    # Both sides are shuffled at every size; the labelled texts are then at hand.
    text = docs.select("doc_id", "text").where(~held_out("doc_id"))
    rows = scratch.write(text.join(own.hint("merge"), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    terms, shares, n1, n0 = learn_lexicon(rows, scratch)
    prior = [0.0] * FEATURES + [math.log((n1 + 0.5) / (n0 + 0.5))]
    if not terms:
        scratch.drop(rows)
        return (terms, frozenset(), frozenset()), prior

    sample = fit_sample(rows, n1 + n0, fit_rows, scratch)
    lexicon_of = terms, *own_words(sample, terms, shares, scratch)

    def run(batches):
        lexicon = Lexicon(*lexicon_of)
        for batch in slices(batches):
            x, y = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x.append(lexicon.features(text))
                y.append(toxic)
                if toxic and (pieces := lexicon.misspelled(text or "")):
                    x.append(lexicon.sums(pieces))
                    y.append(toxic)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], ["x", "toxic"])

    found = sample.mapInArrow(run, "x array<double>, toxic int").collect()
    scratch.drop(rows, sample)
    return lexicon_of, fit([r["x"] for r in found], [r["toxic"] for r in found])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Null and empty texts have no hits and get the score of the bias; a null id
    is not held out; repeated rows come back as often as they came; other
    columns are not read. Scoring is a map over the texts: no shuffle."""
    import pyarrow as pa
    model = train(docs, labels)

    def run(batches):
        scorer = Scorer(*model)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())],
                ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    import pyarrow as pa
    model = train(docs, labels)
    place = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(*model)
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
