"""SQL fragments for the DuckDB oracle (``oracle_sql`` in the driver contract).

Each helper mirrors one column expression of ``cartable.functions`` and is
spelled in DuckDB's dialect (``lambda x: ...``, ``list_*`` functions, RE2).
"""
from __future__ import annotations

from ..functions.render import CONTENT_SEPARATOR, WS_CLASS
from ..functions.terms import WORD_TOKEN_PATTERN

WS = WS_CLASS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    collapsed = f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), {q(WS + '+')}, ' ', 'g')"
    return f"regexp_replace({collapsed}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def flat_cells(rows: str) -> str:
    return (f"list_filter(list_transform(flatten(list_filter({rows}, lambda r: r IS NOT NULL)), "
            f"lambda c: {clean('c')}), lambda c: c <> '')")


def join(lst: str, sep: str) -> str:
    return f"coalesce(array_to_string({lst}, {q(sep)}), '')"


def hdr_n(t: str, header_rows: int) -> str:
    return f"least({int(header_rows)}, len({t}))"


def header_rows_sql(t: str, header_rows: int) -> str:
    return f"list_slice({t}, 1, {hdr_n(t, header_rows)})"


def body_rows_sql(t: str, header_rows: int) -> str:
    return f"list_slice({t}, {hdr_n(t, header_rows)} + 1, len({t}))"


def cap(cells: str, n) -> str:
    return cells if n is None else f"list_slice({cells}, 1, {int(n)})"


def header_text(t: str, header_rows: int = 1) -> str:
    return join(flat_cells(header_rows_sql(t, header_rows)), " | ")


def body_text(t: str, header_rows: int = 1, max_cells=200) -> str:
    return join(cap(flat_cells(body_rows_sql(t, header_rows)), max_cells), " | ")


def render(t: str, header_rows: int = 1, header_weight: int = 3, max_content_cells=200,
           max_length=None, layout: str = "standard") -> str:
    h = header_text(t, header_rows)
    if layout == "entetes_seuls":
        txt = h
    else:
        b = body_text(t, header_rows, max_content_cells)
        if layout == "separe":
            txt = f"({h} || ' {CONTENT_SEPARATOR} ' || {b})"
        else:
            parts = "[" + ", ".join([h] * int(header_weight) + [b]) + "]"
            txt = join(f"list_filter({parts}, lambda x: x <> '')", " ")
    if max_length:
        txt = f"substring({txt}, 1, {int(max_length)})"
    return f"(CASE WHEN coalesce(len({t}), 0) = 0 THEN '' ELSE {txt} END)"


def word_tokens(txt: str, lowercase: bool = True) -> str:
    t = f"lower({txt})" if lowercase else txt
    return f"regexp_extract_all({t}, {q(WORD_TOKEN_PATTERN)})"


def ngrams(tok: str, lo: int = 1, hi: int = 2) -> str:
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(tok)
        else:
            parts.append(f"list_transform(range(1, len({tok}) - {n - 2}), "
                         f"lambda i: array_to_string(list_slice({tok}, i, i + {n - 1}), ' '))")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def ws_words(txt: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(txt)}, {q(WS + '+')}), lambda w: w <> '')"


def char_wb(txt: str, lo: int, hi: int, lowered: bool = False) -> str:
    per_n = []
    for n in range(lo, hi + 1):
        per_n.append(
            f"CASE WHEN len(p) > {n} THEN list_transform(range(1, len(p) - {n - 2}), lambda i: substring(p, i, {n})) "
            f"WHEN greatest({lo}, len(p)) = {n} THEN [p] ELSE []::VARCHAR[] END")
    body = per_n[0]
    for p in per_n[1:]:
        body = f"list_concat({body}, {p})"
    src = txt if lowered else f"lower({txt})"
    return (f"flatten(list_transform(list_transform({ws_words(src)}, lambda w: ' ' || w || ' '), "
            f"lambda p: {body}))")


def char_pre(txt: str) -> str:
    """Code points of the normalised text."""
    return f"regexp_extract_all(regexp_replace(lower({txt}), {q(WS + '{2,}')}, ' ', 'g'), '(?s).')"


def char_grams_of(t: str, lo: int, hi: int) -> str:
    per_n = [f"CASE WHEN len({t}) >= {n} THEN list_transform(range(1, len({t}) - {n - 2}), "
             f"lambda i: array_to_string(list_slice({t}, i, i + {n - 1}), '')) ELSE []::VARCHAR[] END"
             for n in range(lo, hi + 1)]
    body = per_n[0]
    for p in per_n[1:]:
        body = f"list_concat({body}, {p})"
    return body


# The documents table as labelled matrices (first CTE of every text query).
TABLES_CTE = ("tables AS (SELECT doc_id AS id, "
              "list_transform(string_split(text, chr(10)), lambda r: string_split(r, ', ')) AS table_data, "
              "lang AS label FROM documents)")


def with_tables(*ctes: str) -> str:
    return "WITH " + ",\n".join((TABLES_CTE,) + ctes) + "\n"


def tfidf_ctes(text_rel: str, text_col: str = "text", lo: int = 1, hi: int = 2, min_df: int = 2,
               max_features: int | None = 15000, sublinear: bool = True, prefix: str = "",
               analyzer: str = "word", carry: str = "") -> list[str]:
    """CTEs producing ``{prefix}tfidf(id, [carry,] term, idx, weight)`` from ``text_rel(id, text)``."""
    c = f", {carry}" if carry else ""
    if analyzer == "word":
        pre, terms = word_tokens(text_col), ngrams("tok", lo, hi)
    elif analyzer == "char_wb":
        pre, terms = f"lower({text_col})", char_wb("tok", lo, hi, lowered=True)
    else:
        pre, terms = char_pre(text_col), char_grams_of("tok", lo, hi)
    p = prefix
    tfw = "(1 + ln(tf))" if sublinear else "CAST(tf AS DOUBLE)"
    top = (f"ORDER BY cf DESC, term LIMIT {int(max_features)}" if max_features is not None else "")
    return [
        f"{p}toks AS (SELECT id{c}, {pre} AS tok FROM {text_rel})",
        f"{p}terms AS (SELECT id{c}, unnest({terms}) AS term FROM {p}toks)",
        f"{p}counts AS (SELECT id{c}, term, count(*) AS tf FROM {p}terms GROUP BY ALL)",
        f"{p}ndocs AS (SELECT count(*) AS n FROM {text_rel})",
        f"{p}stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {p}counts GROUP BY term HAVING count(*) >= {min_df})",
        f"{p}kept AS (SELECT * FROM {p}stats {top})",
        f"{p}vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, cf, "
        f"ln((1.0 + (SELECT n FROM {p}ndocs)) / (1.0 + df)) + 1.0 AS idf FROM {p}kept)",
        f"{p}raw AS (SELECT c.id{', c.' + carry if carry else ''}, c.term, v.idx, {tfw} * v.idf AS w "
        f"FROM {p}counts c JOIN {p}vocab v ON c.term = v.term)",
        f"{p}tfidf AS (SELECT id{c}, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {p}raw)",
    ]
