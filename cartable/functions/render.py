"""Matrix -> text rendering as pure column expressions.

Everything here returns a ``Column``; no Python runs per row, so the work stays
inside the JVM and is fused with the scan by whole-stage code generation.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
# The separator placed between header text and body text in the "separe"
# layout, and the string used to join cells.
CONTENT_SEPARATOR = "__CONTENU__"
CELL_JOINER = " | "
# Layout names.
LAYOUT_STANDARD = "standard"
LAYOUT_HEADERS_ONLY = "entetes_seuls"
LAYOUT_SEPARATE = "separe"
LAYOUTS = (LAYOUT_STANDARD, LAYOUT_HEADERS_ONLY, LAYOUT_SEPARATE)

# Unicode whitespace as Python's str.isspace() defines it. Java's \s misses
# NBSP and friends, so the class is spelled out; the \x{..} form is accepted
# by both Java regex and RE2 (the SQL oracle).
WS_CLASS = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: drop leading / trailing Unicode whitespace."""
    return F.regexp_replace(_col(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def clean_cell(c) -> Column:
    """Null -> '', stringify, strip, collapse whitespace runs to one space."""
    s = F.coalesce(_col(c).cast("string"), F.lit(""))
    # After the collapse only a plain space can stand at either end.
    return F.trim(F.regexp_replace(s, f"{WS_CLASS}+", " "))


def header_row_count(table, header_rows: int) -> Column:
    """Number of header rows, ``min(header_rows, n)``."""
    return F.least(F.lit(int(header_rows)), F.size(_col(table)))


def header_rows_of(table, header_rows: int) -> Column:
    t = _col(table)
    return F.slice(t, 1, header_row_count(t, header_rows))


def body_rows_of(table, header_rows: int) -> Column:
    # Length is size - h, never a huge constant: slice(t, s, INT_MAX) overflows.
    t = _col(table)
    h = header_row_count(t, header_rows)
    return F.slice(t, h + 1, F.size(t) - h)


def flatten_cells(rows) -> Column:
    """Row-major cells, cleaned once, blanks dropped; null rows skipped."""
    non_null_rows = F.filter(_col(rows), lambda r: r.isNotNull())
    cleaned = F.transform(F.flatten(non_null_rows), clean_cell)
    return F.filter(cleaned, lambda x: x != "")


def cap_cells(cells, max_cells: int | None) -> Column:
    """Keep the first ``max_cells`` cells (after blanks were dropped)."""
    c = _col(cells)
    if max_cells is None:
        return c
    return F.slice(c, 1, int(max_cells))


def join_cells(cells) -> Column:
    """Cells joined with ``' | '``."""
    return F.array_join(_col(cells), CELL_JOINER)


def header_text(table, header_rows: int = 1) -> Column:
    return join_cells(flatten_cells(header_rows_of(table, header_rows)))


def body_text(table, header_rows: int = 1, max_content_cells: int | None = 200) -> Column:
    return join_cells(cap_cells(flatten_cells(body_rows_of(table, header_rows)), max_content_cells))


def truncate_text(txt, max_length: int | None) -> Column:
    """First ``max_length`` characters (code points); falsy = no cut."""
    t = _col(txt)
    if not max_length:
        return t
    return F.substring(t, 1, int(max_length))


def is_empty_table(table) -> Column:
    """P10: null or zero-row matrix."""
    return F.coalesce(F.size(_col(table)), F.lit(0)) <= 0


def render_text(table, header_rows: int = 1, header_weight: int = 3,
                max_content_cells: int | None = 200, max_length: int | None = None,
                layout: str = LAYOUT_STANDARD) -> Column:
    """Render a matrix column ``array<array<string>>`` as one text.

    * ``standard``: header text repeated ``header_weight`` times, then body;
      empty parts dropped, joined by a space.
    * ``entetes_seuls``: header text once.
    * ``separe``: ``"{header} __CONTENU__ {body}"`` (separator always kept).
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; expected one of {LAYOUTS}")
    t = _col(table)
    head = header_text(t, header_rows)
    if layout == LAYOUT_HEADERS_ONLY:
        txt = head
    else:
        body = body_text(t, header_rows, max_content_cells)
        if layout == LAYOUT_SEPARATE:
            txt = F.concat(head, F.lit(f" {CONTENT_SEPARATOR} "), body)
        else:
            parts = F.concat(F.array_repeat(head, int(header_weight)), F.array(body))
            txt = F.array_join(F.filter(parts, lambda x: x != ""), " ")
    return F.when(is_empty_table(t), F.lit("")).otherwise(truncate_text(txt, max_length))


def split_separated(txt) -> tuple[Column, Column]:
    """Split a ``separe`` text at the first separator -> (header, body).

    A missing separator gives an empty body; both sides are stripped.
    """
    parts = F.split(_col(txt), CONTENT_SEPARATOR, 2)
    head = strip_ws(F.get(parts, 0))
    body = strip_ws(F.coalesce(F.get(parts, 1), F.lit("")))
    return head, body


def preprocess_params(header_rows: int = 1, header_weight: int = 3,
                      max_content_cells: int | None = 200, max_length: int | None = None,
                      layout: str = LAYOUT_STANDARD, **_ignored) -> dict:
    """Rendering parameters with the configured defaults."""
    return dict(header_rows=header_rows, header_weight=header_weight,
                max_content_cells=max_content_cells, max_length=max_length, layout=layout)
