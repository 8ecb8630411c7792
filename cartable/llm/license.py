"""Licence scan by canonical digest lookup (DataFrame functions only).

A unit of text - a whole document, or one of its lines - is put into canonical
form: lower case, copyright lines removed, equivalent spellings unified,
punctuation and white space folded. The digest of the whole canonical unit is
hash-joined with the digests of known licence texts in the same form, so only a
unit that says the whole of a licence (or of a licence notice) matches.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as the same word.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "licencor": "licensor", "licencee": "licensee", "sublicence": "sublicense", "authorise": "authorize",
    "authorised": "authorized", "authorisation": "authorization", "organisation": "organization",
    "organisations": "organizations", "recognise": "recognize", "recognised": "recognized", "favour": "favor",
    "behaviour": "behavior", "centre": "center", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "judgement": "judgment", "programme": "program", "whilst": "while", "acknowledgement": "acknowledgment",
    "https": "http",
}

# Licence notices of one line, and short licences as whole texts.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License").', "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
                "SPDX-License-Identifier: GPL-3.0-or-later"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.",
                     "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "BSD-3-Clause": ("Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
}
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
          "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
          "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
          "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
          "USE OR PERFORMANCE OF THIS SOFTWARE.")
TEXTS = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": "ISC License\n\nCopyright <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software "
           "for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
           "permission notice appear in all copies.\n\n" + _AS_IS,
    "0BSD": "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted.\n\n" + _AS_IS,
}


def canonical(text: Column) -> Column:
    """Canonical text; line ends stay line ends."""
    t = F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"))
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, r"\n[ \t>*#/;%-]*(copyright|©|\(c\)|all rights reserved)[^\n]*", "\n")
    t = F.regexp_replace(t, "([a-z])[-‐‑–]([a-z])", "$1$2")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    # One scan finds a word of the table; only texts that hold one are rewritten.
    words = "|".join(sorted(SPELLINGS, key=len, reverse=True))
    changed = t
    for old, new in SPELLINGS.items():
        changed = F.regexp_replace(changed, rf"\b{old}\b", new)
    return F.when(t.rlike(rf"\b({words})\b"), changed).otherwise(t)


def digest(unit: Column) -> Column:
    """Digest of a canonical unit; null if nothing is left of it."""
    folded = F.trim(F.regexp_replace(unit, "[ \n]+", " "))
    return F.when(folded != "", F.md5(folded))


def known(spark: SparkSession, texts: dict[str, str] | None = None,
          notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``(digest, license)`` of the known licences (each row of a fixed table,
    or of the caller's own)."""
    texts, notices = TEXTS if texts is None else texts, NOTICES if notices is None else notices
    rows = [(n, t) for n, t in texts.items()] + [(n, t) for n, ts in notices.items() for t in ts]
    raw = spark.createDataFrame(rows, "license string, raw string")
    return raw.select("license", canonical(F.col("raw")).alias("c")).select(
        digest(F.col("c")).alias("digest"), "license").distinct()


def scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, unit, n)``: how often a licence is the whole document
    (unit ``text``) or a whole line of it (unit ``line``).

    Null and empty texts, copyright lines and units of punctuation alone match
    nothing; a document of one line counts under both units; rows that repeat
    an id add up under it; an empty table gives an empty result; other columns
    are not read. Digests, not texts, are exploded; the known table has one row
    per licence wording. One shuffle, of the matches.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("c"))
    d = d.select("doc_id", digest(F.col("c")).alias("whole"),
                 F.transform(F.split("c", "\n"), digest).alias("lines"))
    units = d.select("doc_id", F.explode(F.concat(
        F.array(F.struct(F.lit("text").alias("unit"), F.col("whole").alias("digest"))),
        F.transform("lines", lambda x: F.struct(F.lit("line").alias("unit"), x.alias("digest"))))).alias("u"))
    units = units.select("doc_id", "u.unit", "u.digest").where("digest is not null")
    return (units.join(licenses, "digest").groupBy("doc_id", "license", "unit")
            .agg(F.count(F.lit(1)).alias("n")))


def oracle() -> str:
    """The scan of ``documents`` in DuckDB's SQL."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rep = lambda x, pattern, new: f"regexp_replace({x}, {q(pattern)}, {new}, 'g')"
    c = "chr(10) || lower(coalesce(raw, '')) || chr(10)"
    c = rep(c, "\r\n?", "chr(10)")
    c = rep(c, r"\n[ \t>*#/;%-]*(copyright|©|\(c\)|all rights reserved)[^\n]*", "chr(10)")
    c = rep(c, "([a-z])[-‐‑–]([a-z])", q(r"\1\2"))
    c = rep(c, r"[^\p{L}\p{N}\n]+", "' '")
    for old, new in SPELLINGS.items():
        c = rep(c, rf"\b{old}\b", q(new))
    fold = lambda x: f"trim({rep(x, '[ ' + chr(10) + ']+', chr(39) + ' ' + chr(39))})"
    known_rows = ", ".join(f"({q(n)}, {q(t)})" for n, t in [*TEXTS.items(), *((n, t) for n, ts in NOTICES.items() for t in ts)])
    return f"""
WITH known(license, raw) AS (VALUES {known_rows}),
k AS (SELECT DISTINCT license, md5({fold('c')}) AS digest FROM (SELECT license, {c} AS c FROM known)),
d AS (SELECT doc_id, {c} AS c FROM (SELECT doc_id, text AS raw FROM documents)),
u AS (SELECT doc_id, 'text' AS unit, {fold('c')} AS f FROM d
  UNION ALL SELECT doc_id, 'line', {fold('l')} FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS l FROM d))
SELECT doc_id, license, unit, count(*) AS n FROM u JOIN k ON md5(u.f) = k.digest WHERE u.f <> '' GROUP BY ALL"""
