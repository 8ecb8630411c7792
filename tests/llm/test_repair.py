"""Conversation repair: block tables against a plain program, rows against a plain repair."""
import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartable.llm import repair as R
from cartable.llm.common import table
from tests.conftest import SF

ACCEPTED = re.compile(r"(s?(ua)+)?")


def plain_edits(symbols):
    """(cost, least audit) by a full program over (rows left, state), backwards."""
    after = {q: (0, "") for q in (0, 3)}
    for k in range(len(symbols), -1, -1):
        here = dict(after) if k == len(symbols) else {}
        for _ in range(5):
            for q in range(4):
                options = [here[q]] if q in here else []
                if k < len(symbols):
                    options += [(after[r][0] + c, e + after[r][1]) for e, r, c in R.moves(q, symbols[k]) if r in after]
                if R.NEXT[q] in here:
                    options.append((here[R.NEXT[q]][0] + 3, "I" + here[R.NEXT[q]][1]))
                if options:
                    here[q] = min(options)
        after = here
    return after[0]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=14))
def test_cost_and_least_edits_equal_plain_program(symbols):
    assert R.tables().run(symbols) == plain_edits(symbols)


def test_every_short_sequence_and_every_block_length():
    import itertools
    for n in range(5):
        for symbols in itertools.product(range(9), repeat=n):
            want = plain_edits(symbols)
            assert R.tables().run(list(symbols)) == want
    rnd = random.Random(5)
    for block in (1, 2, 3, 5):
        for n in (0, 1, 7, 40, 301):
            symbols = [rnd.choice([0, 1, 2, 2, 1, 3, 5, 6, 8]) for _ in range(n)]
            assert R.tables(block).run(symbols) == plain_edits(symbols)


def plain_repair(rows):
    """rows: (turn, role, text), damaged, nulls replaced."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, symbols = set(), [], []
    for _, role, text in rows:
        core = text.strip(R.SPACE)
        fault = "blank" if not core else "dup" if (role, text) in seen else "trunc" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        i = "sua".find(role[:1]) if role else -1
        symbols.append(8 if fault in ("blank", "dup") else (3 if i < 0 else i) + (4 if fault == "trunc" else 0))
    kinds = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
    cost, audit = plain_edits(symbols)
    out, state, it = [], "", iter(rows)
    for e in audit:
        need = {"": "user", "s": "user", "a": "user", "u": "assistant"}[state]
        if e == "I":
            out.append((need, ""))
        else:
            _, role, text = next(it)
            if e == "D":
                continue
            out.append((need if e == "R" else role, text))
        state = out[-1][0][:1]
    assert ACCEPTED.fullmatch("".join(r[:1] for r, _ in out))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *[faults.count(f) for f in ("blank", "dup", "trunc")], illegal, cost, audit, sha


def plain_query(rows):
    """rows: (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        one = out.setdefault(conv, [])
        sp = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else sp(role), "" if kind == 1 else sp(text)
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        one += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: plain_repair(r) for c, r in out.items()}


def collected(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_plain_repair(spark):
    from __spark_entry__ import queries
    sf = SF.replace("0.001", "0.01")
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries()["op11_conversation_repair"](spark, sf)) == plain_query(rows)


SCHEMA = "conv_id long, turn long, role string, text string, present string, _c int, pos int"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def _random_rows(seed, convs, turns):
    rnd = random.Random(seed)
    return [(c, rnd.choice([None, t, t, t, t // 2]), rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
             rnd.choice(["Hi.", "", None, " \t", "no end", "Yes!", "a? b", f"t{t}.", "ends. \n", "é…", "Hi."]))
            for c in convs for t in range(turns(rnd))]


def test_nulls_ties_and_extra_columns(spark):
    rows = _random_rows(1, [None, 1, 2, 3, 4, 5, -6], lambda r: r.randrange(1, 30))
    got = collected(R.repaired_digests(R.repair(R.damage(_table(spark, rows)), F.col("present"))))
    assert got == plain_query(rows)


def test_long_conversations_take_the_other_way_with_equal_rows(spark):
    rows = _random_rows(2, [None, 7, 8], lambda r: r.choice([255, 700, 1030])) + _random_rows(3, range(20, 30), lambda r: r.randrange(1, 6))
    dropped = next(c for c in range(100, 2000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    rows += [(dropped, 0, "user", "Hi.")] * 5
    found = R.repair(R.damage(_table(spark, rows)), F.col("present"), long_rows=4)
    assert found.reports is not None and found.reports.count() >= 4
    got = collected(R.repaired_digests(found))
    assert got == plain_query(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_whole_rows_of_the_operator_and_empty_table(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?"), (1, 3, "assistant", "Yes")]
    r = R.repair(_table(spark, rows)).whole.first()
    assert r["audit"] == "KKDK" and r["cost"] == 7 and [tuple(x) for x in r["repaired"]] == [
        ("system", "Be kind."), ("user", "Hi?"), ("assistant", "Yes")]
    empty = R.repair(_table(spark, rows).limit(0))
    assert empty.whole.count() == 0 and empty.reports is None
