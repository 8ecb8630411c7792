"""Conversation structure repair by Four-Russians block tables.

A conversation is legal if its role initials read ``(s?(ua)+)?``. The cheapest
edits to make it so are found by a dynamic program over four states (start, s, u,
a). Its cost vectors, less their minimum, take only a few dozen values, so for
every vector and every block of ``BLOCK`` row symbols the resulting vector and
its rise are computed once; a conversation is then read a block at a time by
table lookup. Blocks are expanded afterwards from the last to the first, keeping
only cells on some cheapest path, and at each of these the ASCII-least edit, so
ties are resolved without a second search.

Rows are sorted by conversation inside partitions and read as a stream, one
conversation in memory. Conversations of over ``LONG_ROWS`` rows or ``LONG_BYTES``
of text never meet in one task: their rows are numbered by range partitions,
repeats are found by grouping on digests, and the program sees one character a
row (no more than the audit it returns); texts are repaired in pieces of ``PIECE``
rows.

Defined cases: a null role, text, conversation id (in its key) is one space, and a
null id is a conversation of its own; null turns come first; rows of one turn are
ordered by role and text; a role that begins with none of s, u, a (or is empty) can
only be renamed or deleted; a conversation whose rows are all absent has zeros and
an empty audit; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ordered_index

SPACE = " \t\n\x0b\x0c\r"
BLOCK = 4                       # symbols of a block
LONG_ROWS, LONG_BYTES, PIECE = 4096, 4 << 20, 256
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1000                      # a cell no cheapest path goes through

# States: 0 start, 1 after s, 2 after u, 3 after a. NEXT is the state after the
# one letter that may be written (u from start, s and a; a from u).
NEXT = (2, 2, 3, 2)
KEPT = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})  # by initial (s, u, a, other): state -> state
ACCEPT = (0, 3)
ROLE = {2: "user", 3: "assistant"}

# A row's code is one character: 4 * fault + initial. Faults: none, blank, duplicate, truncated.
INITIALS, CODES = "sua", "0123456789abcdef"
LEGAL = {(0, 1), (1, 2), (2, 1)}
DELETED = 8                     # symbol of a blank or duplicate row; 0-3 sound, 4-7 truncated
SYMBOL = {c: (i if i < 4 else i - 8 if i >= 12 else DELETED) for i, c in enumerate(CODES)}
SYMBOLS = 9


def initial(role: str) -> int:
    return INITIALS.find(role[0]) % 4 if role else 3


def moves(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """Edits that consume a row of this symbol: (initial, next state, cost)."""
    out = [("D", state, DELETE)]
    if symbol != DELETED:
        extra = TRUNCATED if symbol >= 4 else 0
        if state in KEPT[symbol % 4]:
            out.append(("K", KEPT[symbol % 4][state], KEEP + extra))
        out.append(("R", NEXT[state], RENAME + extra))
    return out


def _inserted(x: list[int]) -> list[int]:
    """Cost vector after any insertions (two in a row reach every state)."""
    for _ in range(2):
        for q in range(4):
            x[NEXT[q]] = min(x[NEXT[q]], x[q] + INSERT)
    return x


def _step(x: tuple, symbol: int) -> tuple[tuple, int]:
    """The next cost vector less its minimum, and that minimum. Start costs more
    than a by over one deletion, or s more than a, is strictly worse: from a the
    same rest can be had for less, so such cells are put out of reach."""
    y = [FAR] * 4
    for q in range(4):
        if x[q] < FAR:
            for _, r, cost in moves(q, symbol):
                y[r] = min(y[r], x[q] + cost)
    y = _inserted(y)
    low = min(y)
    y = [min(v - low, FAR) for v in y]
    if y[0] > y[3] + DELETE:
        y[0] = FAR
    if y[1] > y[3]:
        y[1] = FAR
    return tuple(y), low


class Tables:
    """Vectors reachable from the start, single steps, and block transitions."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors = [tuple(_inserted([0, FAR, FAR, FAR]))]
        place, self.step = {self.vectors[0]: 0}, []
        for x in self.vectors:  # grows while it is read
            row = []
            for c in range(SYMBOLS):
                y, low = _step(x, c)
                if y not in place:
                    place[y] = len(self.vectors)
                    self.vectors.append(y)
                row.append((place[y], low))
            self.step.append(row)
        # jump[v][block]: vector and rise behind every block, its first symbol leading.
        self.jump = [[(v, 0)] for v in range(len(self.vectors))]
        for _ in range(block):
            self.jump = [[(w, rise + more) for u, rise in row for w, more in self.jump[u]] for row in self.step]
        self.expand = lru_cache(maxsize=1 << 15)(self._expand)

    def run(self, symbols: list[int]) -> tuple[int, str]:
        """Cheapest cost and its ASCII-least edits."""
        L, n = self.block, len(symbols)
        v, cost, blocks = 0, 0, []
        for i in range(0, n - n % L, L):
            key = 0
            for c in symbols[i:i + L]:
                key = key * SYMBOLS + c
            blocks.append((v, tuple(symbols[i:i + L])))
            v, rise = self.jump[v][key]
            cost += rise
        if n % L:
            blocks.append((v, tuple(symbols[n - n % L:])))
            for c in blocks[-1][1]:
                v, rise = self.step[v][c]
                cost += rise
        x = self.vectors[v]
        best = min(x[q] for q in ACCEPT)
        ends = {q: "" for q in ACCEPT if x[q] == best}
        for q in sorted(range(4), key=lambda q: -x[q]):
            if q not in ends and NEXT[q] in ends and x[q] + INSERT == x[NEXT[q]]:
                ends[q] = "I" + ends[NEXT[q]]
        alive, paths = frozenset(ends), []
        for v, symbols_ in reversed(blocks):
            path = self.expand(v, symbols_, alive)
            paths.append(path)
            alive = frozenset(path)
        q, out = 0, []
        for path in reversed(paths):
            edits, q = path[q]
            out.append(edits)
        return cost + best, "".join(out) + ends[q]

    def _expand(self, v: int, symbols: tuple, alive: frozenset) -> dict:
        """``{state at the left edge: (least edits through the block, state at the
        right edge)}`` of the cells that lie on a cheapest path."""
        layers = [(v, 0)]
        for c in symbols:
            w, rise = self.step[layers[-1][0]][c]
            layers.append((w, rise))
        after = {q: ("", q) for q in alive}
        for k in range(len(symbols) - 1, -1, -1):
            x, y, rise = self.vectors[layers[k][0]], self.vectors[layers[k + 1][0]], layers[k + 1][1]
            here: dict = {}
            for q in sorted(range(4), key=lambda q: -x[q]):  # an insertion leads to a dearer cell
                if x[q] >= FAR:
                    continue
                options = [(e + after[r][0], after[r][1]) for e, r, cost in moves(q, symbols[k])
                           if r in after and y[r] + rise == x[q] + cost]
                r = NEXT[q]
                if r in here and x[r] == x[q] + INSERT:
                    options.append(("I" + here[r][0], here[r][1]))
                if options:
                    here[q] = min(options)
            after = here
        return after


@lru_cache(maxsize=4)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def repair_codes(codes: str) -> tuple[int, int, int, int, int, str]:
    """(blank, duplicate, truncated, illegal, cost, audit) of a conversation's codes."""
    faults = [sum(map(codes.count, CODES[f * 4:f * 4 + 4])) for f in (1, 2, 3)]
    kinds = [int(c, 16) % 4 for c in codes]
    illegal = sum(p not in LEGAL for p in zip(kinds, kinds[1:]))
    return *faults, illegal, *tables().run([SYMBOL[c] for c in codes])


def apply(edits: str, rows: Iterator[tuple[str, str]], state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The rows that the edits leave, and the state behind them."""
    out = []
    for e in edits:
        if e == "I":
            state = NEXT[state]
            out.append((ROLE[state], ""))
            continue
        role, text = next(rows)
        if e == "R":
            state = NEXT[state]
            out.append((ROLE[state], text))
        elif e == "K":
            state = KEPT[initial(role)][state]
            out.append((role, text))
    return out, state


# ------------------------------------------------------------------ rows
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "array<struct<role:string,text:string>>"


def _turns(lists: list[list[tuple[str, str]]]) -> pa.Array:
    flat = [x for one in lists for x in one]
    ends = [0]
    for one in lists:
        ends.append(ends[-1] + len(one))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        [pa.array([r for r, _ in flat], pa.string()), pa.array([t for _, t in flat], pa.string())], ["role", "text"]))


def _rows(batches, names):
    for b in batches:
        yield from zip(*[b.column(n).to_pylist() for n in names])


def _conversations(id_type):
    def work(batches):
        out, held = [], 0
        names = ("_c", "conv_id", "turn", "role", "text", "present")
        for _, rows in groupby(_rows(batches, names), key=lambda r: r[0]):
            codes, turns, seen, kept, conv_id = [], set(), set(), [], None
            for _, conv_id, turn, role, text, present in rows:
                if not present:
                    continue
                if turn is not None:
                    turns.add(turn)
                core = text.strip(SPACE)
                fault = 1 if not core else 2 if (role, text) in seen else 3 if core[-1] not in ".!?" else 0
                seen.add((role, text))
                codes.append(CODES[4 * fault + initial(role)])
                kept.append((role, text))
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            report = repair_codes("".join(codes))
            repaired = apply(report[-1], iter(kept))[0]
            out.append((conv_id, gaps, *report, repaired))
            held += sum(len(t) for _, t in repaired) + 100
            if held > 4 << 20:
                yield _batch(out, id_type)
                out, held = [], 0
        if out:
            yield _batch(out, id_type)
    return work


def _batch(rows: list, id_type) -> pa.RecordBatch:
    conv, gaps, blank, dup, trunc, illegal, cost, audit, repaired = zip(*rows)
    numbers = [pa.array(x, pa.int64()) for x in (gaps, blank, dup, trunc, illegal, cost)]
    return pa.RecordBatch.from_arrays([pa.array(conv, id_type), *numbers, pa.array(audit, pa.string()), _turns(repaired)],
                                      ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"])


def _keyed(rows: DataFrame, present: Column) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("_c"), "conv_id", F.col("turn").cast("long"),
                       text("role").alias("role"), text("text").alias("text"), present.alias("present"))


class Repaired:
    """``whole``: a row per ordinary conversation with its report and repaired turns.
    ``reports`` and ``pieces`` (None without long conversations): the reports of
    the long ones, and their repaired turns as ``(conv_id, piece, repaired)``."""

    def __init__(self, whole: DataFrame, reports: DataFrame | None = None, pieces: DataFrame | None = None):
        self.whole, self.reports, self.pieces = whole, reports, pieces


def repair(rows: DataFrame, present: Column | None = None, scratch: Scratch | None = None,
           long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> Repaired:
    """Repair every conversation of ``(conv_id, turn, role, text)``. Rows for which
    ``present`` is false only name their conversation."""
    from pyspark.sql.pandas.types import to_arrow_type
    scratch = scratch or Scratch(rows.sparkSession, "repair")
    keyed = _keyed(rows, F.lit(True) if present is None else present)
    # Sizes: one row per conversation, added up before the shuffle.
    sizes = keyed.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b"))
    long = scratch.write(sizes.where((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select("_c"), "long")
    any_long = not long.isEmpty()
    rest = keyed.join(long, "_c", "left_anti") if any_long else keyed
    id_type = rows.schema["conv_id"].dataType
    whole = (rest.repartition("_c").sortWithinPartitions("_c", "turn", "role", "text")
             .mapInArrow(_conversations(to_arrow_type(id_type)), f"conv_id {id_type.simpleString()}, {REPORT}, repaired {TURNS}"))
    if not any_long:
        return Repaired(whole)
    return Repaired(whole, *_repair_long(keyed.join(long, "_c", "left_semi"), scratch))


def _repair_long(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    ids = rows.groupBy("_c").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"))
    live = ordered_index(rows.where("present").drop("present"), ["_c", "turn", "role", "text"], scratch, "idx")
    first = live.groupBy("_c").agg(F.min("idx").alias("_first"))
    core = F.rtrim(F.translate("text", SPACE[1:], " " * 5))
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    live = scratch.write(live.join(first, "_c").select(
        "_c", "conv_id", "turn", "role", "text", (F.col("idx") - F.col("_first")).alias("pos"), said.alias("said"),
        (F.length(F.trim(core)) == 0).alias("blank"), F.substring(core, -1, 1).isin(".", "!", "?").alias("ended")), "live")
    # Smallest place of each (role, text): one row per distinct pair, however often it is repeated.
    seen = live.groupBy("_c", "said").agg(F.min("pos").alias("_seen"))
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("_seen"), 2).when(~F.col("ended"), 3).otherwise(0)
    kind = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(INITIALS)], F.lit(3))
    coded = live.join(seen, ["_c", "said"]).select("_c", "pos", F.lower(F.hex(4 * fault + kind)).alias("code"))
    in_order = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v]), "")
    pieces = coded.groupBy("_c", F.floor(F.col("pos") / PIECE).alias("p")).agg(in_order("pos", "code").alias("codes"))
    codes = pieces.groupBy("_c").agg(in_order("p", "codes").alias("codes"))
    solved = scratch.write(codes.mapInArrow(_solve, "_c string, piece long, state int, edits string, blank long, duplicate long, "
                                            "truncated long, illegal long, cost long"), "solved")
    turns = live.groupBy("_c", "turn").agg(F.lit(1).alias("_")).groupBy("_c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    reports = (ids.join(solved.where("piece = -1").withColumnRenamed("edits", "audit"), "_c", "left").join(turns, "_c", "left")
               .select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                       F.coalesce("audit", F.lit("")).alias("audit")))
    edits = solved.where("piece >= 0").select("_c", "piece", "state", "edits")
    id_type = rows.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    repaired = (live.select("_c", "conv_id", F.floor(F.col("pos") / PIECE).alias("piece"), "pos", "role", "text")
                .join(edits, ["_c", "piece"]).repartition("_c", "piece").sortWithinPartitions("_c", "piece", "pos")
                .mapInArrow(_apply_pieces(to_arrow_type(id_type)), f"conv_id {id_type.simpleString()}, piece long, repaired {TURNS}"))
    return reports, repaired


def _solve(batches):
    """A report row (piece -1) per conversation, and for every piece its edits and
    the state before it. Insertions behind the last row belong to its piece."""
    for b in batches:
        for c, codes in zip(b.column("_c").to_pylist(), b.column("codes").to_pylist()):
            *numbers, audit = repair_codes(codes)
            out, state, at, start, first = [], 0, 0, 0, 0
            for i, e in enumerate(audit):
                if at == (len(out) + 1) * PIECE and at < len(codes):
                    out.append((first, audit[start:i]))
                    start, first = i, state
                if e == "I":
                    state = NEXT[state]
                else:
                    state = state if e == "D" else NEXT[state] if e == "R" else KEPT[int(codes[at], 16) % 4][state]
                    at += 1
            out.append((first, audit[start:]))
            n = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * (n + 1), pa.string()), pa.array(range(-1, n), pa.int64()),
                 pa.array([0] + [s for s, _ in out], pa.int32()), pa.array([audit] + [e for _, e in out], pa.string()),
                 *[pa.array([x] + [None] * n, pa.int64()) for x in numbers]],
                ["_c", "piece", "state", "edits", "blank", "duplicate", "truncated", "illegal", "cost"])


def _apply_pieces(id_type):
    def work(batches):
        names = ("_c", "piece", "conv_id", "role", "text", "state", "edits")
        for (_, piece), rows in groupby(_rows(batches, names), key=lambda r: r[:2]):
            rows = list(rows)  # a piece
            done = apply(rows[0][6], iter([(r[3], r[4]) for r in rows]), rows[0][5])[0]
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][2]], id_type), pa.array([piece], pa.int64()), _turns([done])],
                                             ["conv_id", "piece", "repaired"])
    return work


# ---------------------------------------------------------------- query
def damage(rows: DataFrame) -> DataFrame:
    """The rows of a conversation table with faults dealt by crc32 of
    ``conv_id:turn`` modulo 20; a dropped row stays with ``present`` false."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    present = F.when(kind == 0, F.array(F.lit(False))).when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.explode(present).alias("present"))


def _digests(id_type):
    """SHA-256 of each long conversation's lines, read as a stream: the value itself
    is sequential, so one conversation is one task's stream, never its memory."""
    def work(batches):
        for key, rows in groupby(_rows(batches, ("_c", "conv_id", "repaired")), key=lambda r: r[0]):
            h, some, conv_id = hashlib.sha256(), False, None
            for _, conv_id, turns in rows:
                for t in turns:
                    h.update((("\n" if some else "") + t["role"] + ":" + t["text"]).encode())
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], id_type), pa.array([h.hexdigest()])], ["conv_id", "sha"])
    return work


def repaired_digests(found: Repaired) -> DataFrame:
    """The report of every conversation with the digest of its repaired lines."""
    from pyspark.sql.pandas.types import to_arrow_type
    lines = F.concat_ws("\n", F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])))
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    out = found.whole.select(*cols, F.sha2(lines, 256).alias("repaired_sha256"))
    if found.reports is None:
        return out
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    id_type = found.pieces.schema["conv_id"].dataType
    sha = (found.pieces.withColumn("_c", key).repartition("_c").sortWithinPartitions("_c", "piece")
           .mapInArrow(_digests(to_arrow_type(id_type)), f"conv_id {id_type.simpleString()}, sha string"))
    long = found.reports.withColumn("_c", key).join(sha.select(key.alias("_c"), "sha"), "_c", "left")
    return out.unionByName(long.select(*cols, F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))
