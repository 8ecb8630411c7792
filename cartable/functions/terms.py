"""Text -> terms as column expressions.

All analyzers return ``array<string>`` with one element per occurrence, so a
later ``explode`` + ``groupBy`` counts term frequencies.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .render import WS_CLASS, _col, strip_ws

# Fixed values -------------------------------------------------------------
# A word token is a maximal run of two or more word characters (letters,
# digits, underscore).
WORD_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Keyword lexicon per class. A class flag is 1.0 when any of its keywords is
# a substring of the lower-cased text. These lists are fixed values.
DEFAULT_KEYWORDS: dict[str, list[str]] = {
    "batiment": [
        "batiment", "bâtiment", "immeuble", "surface", "construction", "bati",
        "local", "commune", "adresse", "m2", "m²", "logement", "ets",
        "établissement", "etablissement",
    ],
    "vehicule": [
        "vehicule", "véhicule", "immatriculation", "marque", "modele", "modèle",
        "moteur", "carburant", "km", "kilometrage", "kilométrage", "puissance",
        "cylindree", "cylindrée", "voiture", "camion", "bus", "mec",
    ],
    "sinistre": [
        "sinistre", "franchise", "indemnite", "indemnité", "garantie",
        "déclaration", "declaration", "evenement", "événement", "montant",
        "reglement", "règlement", "nature", "expertise", "recours",
    ],
}
# The configured class list, in declared order, and the id given to an
# unknown label on the transformer path.
DEFAULT_CLASSES = ["batiment", "vehicule", "sinistre", "autre"]
UNKNOWN_LABEL_ID = 3


def lower(c) -> Column:
    """F01."""
    return F.lower(_col(c))


def word_tokens(txt, lowercase: bool = True) -> Column:
    """word tokens in text order."""
    t = _col(txt)
    if lowercase:
        t = F.lower(t)
    return F.regexp_extract_all(t, F.lit(WORD_TOKEN_PATTERN), 0)


def _window_join(tok: Column, n: int):
    # One-argument lambdas only: F.transform passes the index to a
    # two-argument function. ``i`` is 1-based; the n tokens are read by index
    # and joined directly (no intermediate slice array per n-gram).
    return lambda i: F.concat_ws(" ", *[F.get(tok, i - 1 + j) for j in range(n)])


def _window_substr(s: Column, n: int):
    return lambda i: F.substring(s, i, n)


def word_ngrams(tokens, lo: int = 1, hi: int = 2) -> Column:
    """all word n-grams for n in [lo, hi], space-joined.

    ``sequence(0, size - n)`` would count down for short inputs, so every n is
    guarded by ``size >= n``.
    """
    tok = _col(tokens)
    parts = []
    for n in range(int(lo), int(hi) + 1):
        if n == 1:
            parts.append(tok)
            continue
        grams = F.transform(F.sequence(F.lit(1), F.size(tok) - (n - 1)), _window_join(tok, n))
        parts.append(F.when(F.size(tok) >= n, grams).otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def whitespace_words(txt) -> Column:
    """Python ``str.split()``: split on Unicode whitespace runs, no empties."""
    return F.filter(F.split(strip_ws(_col(txt)), f"{WS_CLASS}+"), lambda w: w != "")


def char_wb_ngrams(txt, lo: int = 2, hi: int = 4, lowercase: bool = True) -> Column:
    """character n-grams inside word boundaries.

    Each whitespace word is padded with one space on both sides. For every n,
    all windows of length n are emitted; a padded word no longer than n is
    emitted once as a whole and larger n are skipped for it.
    """
    t = F.lower(_col(txt)) if lowercase else _col(txt)
    # Pad each word once; the window lambda then reads a lambda variable.
    padded = F.transform(whitespace_words(t), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams_of(p):
        ln = F.length(p)
        per_n = []
        for n in range(int(lo), int(hi) + 1):
            windows = F.transform(F.sequence(F.lit(1), ln - (n - 1)), _window_substr(p, n))
            per_n.append(
                F.when(ln > n, windows)
                .when(F.greatest(F.lit(int(lo)), ln) == n, F.array(p))
                .otherwise(F.array().cast("array<string>")))
        return F.concat(*per_n) if len(per_n) > 1 else per_n[0]

    return F.flatten(F.transform(padded, grams_of))


def normalize_for_char_ngrams(txt, lowercase: bool = True) -> Column:
    """Runs of two or more whitespace characters become one space."""
    t = F.lower(_col(txt)) if lowercase else _col(txt)
    return F.regexp_replace(t, f"{WS_CLASS}{{2,}}", " ")


def char_ngram_windows(t, lo: int = 2, hi: int = 4) -> Column:
    """F06 on a normalised text: per n, one regex pass gives all windows of n characters
    (code points). A match consumes one character and captures the n from there, so a
    window costs one match, not a slice, a join and a lambda call."""
    per_n = [F.regexp_extract_all(_col(t), F.lit(rf"(?s)(?=(.{{{n}}}))."), 1) for n in range(int(lo), int(hi) + 1)]
    return F.concat(*per_n) if len(per_n) > 1 else per_n[0]


def char_ngrams(txt, lo: int = 2, hi: int = 4, lowercase: bool = True) -> Column:
    """character n-grams over the text, runs of 2+ whitespace -> one space.

    For long texts project ``normalize_for_char_ngrams(t)`` into its own column
    first and call ``char_ngram_windows`` on it.
    """
    return char_ngram_windows(normalize_for_char_ngrams(txt, lowercase), lo, hi)


def keyword_flag(txt, keywords: list[str], whole_word: bool = False) -> Column:
    """1.0 if any keyword is a substring of the lower-cased text."""
    t = F.lower(_col(txt))
    if not keywords:
        return F.lit(0.0)
    if whole_word:
        import re
        alt = "|".join(re.escape(k) for k in keywords)
        return F.regexp_like(t, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{alt})(?![\p{{L}}\p{{N}}_])")).cast("double")
    # One lower-cased text (a common subexpression), one search per keyword.
    hit = F.contains(t, F.lit(keywords[0]))
    for k in keywords[1:]:
        hit = hit | F.contains(t, F.lit(k))
    return hit.cast("double")


def keyword_flags(txt, lexicon: dict[str, list[str]] | None = None, prefix: str = "kw_") -> list[Column]:
    """One flag column per class of the lexicon, in lexicon order."""
    lexicon = DEFAULT_KEYWORDS if lexicon is None else lexicon
    return [keyword_flag(txt, words).alias(f"{prefix}{cls}") for cls, words in lexicon.items()]


def label_to_id(label, classes: list[str] | None = None, default: int = UNKNOWN_LABEL_ID) -> Column:
    """label -> position in the class list; unknown -> ``default``."""
    classes = DEFAULT_CLASSES if classes is None else classes
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    return F.coalesce(F.element_at(m, _col(label)), F.lit(int(default)))


def id_to_label(idx, classes: list[str] | None = None) -> Column:
    """id -> label; out of range -> NULL."""
    classes = DEFAULT_CLASSES if classes is None else classes
    arr = F.array(*[F.lit(c) for c in classes])
    return F.try_element_at(arr, _col(idx).cast("int") + 1)


def display_timestamp(iso) -> Column:
    """first 19 characters of an ISO timestamp, ``T`` -> space."""
    return F.replace(F.substring(_col(iso), 1, 19), F.lit("T"), F.lit(" "))


ACCENT_MODES = ("unicode", "ascii")


def strip_accents(c, mode: str = "unicode") -> Column:
    """NFKD, then drop combining marks (``unicode``) or everything outside
    ASCII (``ascii``). Arrow-batched; texts that are ASCII already pass through."""
    import pandas as pd
    import unicodedata
    if mode not in ACCENT_MODES:
        raise ValueError(f"unknown accent mode {mode!r}; expected one of {ACCENT_MODES}")

    @F.pandas_udf("string")
    def _strip(s: pd.Series) -> pd.Series:
        odd = s[~s.map(lambda x: x is None or x.isascii())]
        if len(odd):
            apart = odd.str.normalize("NFKD")
            if mode == "ascii":
                done = apart.map(lambda x: x.encode("ascii", "ignore").decode())
            else:
                # One table of the marks that occur, then one C-level pass a text.
                marks = {ord(ch): None for ch in set().union(*apart) if unicodedata.combining(ch)}
                done = apart.str.translate(marks)
            s = s.copy()
            s[odd.index] = done
        return s

    return _strip(_col(c))


def strip_accents_unicode(c) -> Column:
    """F02, ``unicode`` mode."""
    return strip_accents(c, "unicode")
