"""op6, op7, op10: ids against the library, round trips, damaged files, rollups."""
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartable.llm import bpe, records, rollup
from cartable.llm.common import Scratch
from cartable.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
PARTS = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "²", "<|endoftext|>", "'s", "'ll", "!", "...", "日本", "՘",
         " ", "　", "😀", "\x1c", "ꟲ", " x", "word", "the ", "\r\n", "\x00", "ÀÉ", "unbelievably"]
ROWS = [(3, None, "x"), (1, "", "x"), (2, " ", "x"), (5, "a <|endoftext|> b", "x"), (5, "a <|endoftext|> b", "x"),
        (4, "word " * 60_000, "x"), (6, "y" * 200_000, "x"), (7, "plain words here", "x")]
SCHEMA = "doc_id bigint, text string, ids string"


def lib(text):
    return np.array(LIB.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def random_text(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))


def test_bpe_equals_library():
    own, rng = bpe.Bpe(PATH, cache_pieces=50), random.Random(1)
    for _ in range(4000):
        t = random_text(rng)
        ids = own.encode(t)
        assert ids == lib(t), repr(t)
        assert own.decode(ids) == LIB.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_scan_and_heap_make_the_same_merges():
    own, rng = bpe.Bpe(PATH), random.Random(2)
    for _ in range(300):
        w = "".join(rng.choice("abeinrst ") for _ in range(rng.randint(1, 120))).encode()
        assert own.word(w) == own._long([own.byte_id[b] for b in w])


def test_words_of_mixed_pieces_are_merged_once():
    own, merged = bpe.Bpe(PATH), []
    plain = own.word
    own.word = lambda w: merged.append(w) or plain(w)
    text = "start alpha, alpha. (alpha) beta\nalpha; alpha beta, beta\nalpha alpha\nbeta."
    assert own.encode(text) == lib(text)
    assert merged and len(merged) == len(set(merged))


def test_long_pieces_are_not_kept():
    own = bpe.Bpe(PATH)
    text = "a " + "y" * 5000 + " " + "z!" * 3000 + " b"
    assert own.encode(text) == lib(text)
    assert all(len(k) <= bpe.CACHE_CHARS for c in (own._cache, own._kept) for k in c)


def test_decode_replaces_what_is_not_utf8():
    own = bpe.Bpe(PATH)
    part = own.encode("日")[:4]
    assert own.decode(part) == LIB.decode(np.frombuffer(part, "<u4").tolist(), skip_special_tokens=False)


def test_encode_decode_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = bpe.encode_decode(df, path=PATH).collect()
    assert sorted((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded) for r in got) == sorted(
        (i, lib(t), len(lib(t)) // 4, t or "") for i, t, _ in ROWS)
    assert bpe.encode_decode(df.limit(0), path=PATH).count() == 0


def test_op10_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op10_bpe_round_trip"](spark, SF).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {tuple(r) for r in got} == {(i, len(lib(t)) // 4, sha(lib(t)), sha(t.encode())) for i, t in docs.items()}


def test_library_encoder_equals_library():
    enc, rng = records.LibraryEncoder(PATH, width=4), random.Random(3)
    enc.cache.limit = 20
    for _ in range(60):
        texts = [random_text(rng) for _ in range(rng.randint(1, 40))]
        assert enc.encode(texts) == [lib(t) for t in texts]


def test_library_sees_each_word_and_each_tail_once():
    enc, asked, rng = records.LibraryEncoder(PATH), [], random.Random(4)
    plain = enc.pieces
    enc.pieces = lambda pieces, lead=" ": asked.extend((lead, p) for p in pieces) or plain(pieces, lead)
    text = "start alpha, alpha.\nBeta (alpha) alpha*** beta.\nBeta beta's 12, 12. beta1, beta*** x"
    assert [np.frombuffer(i, "<u2").tolist() for i in enc.encode([text, None, ""]) + enc.encode([text])] == [
        LIB.encode(t, add_special_tokens=False).ids for t in (text, "", "", text)]
    assert len(asked) == len(set(asked))
    assert {p for lead, p in asked if lead} == {"start", "alpha", "beta", "(", "12", "x"}
    parts = [*PARTS, " ", " ", "\x85", "\xa0", "\x1d", "_", "Ǆ", "½", "٣", "<|endoftext", "'", "a.\nB"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(9)]
        assert [np.frombuffer(i, "<u2").tolist() for i in enc.encode(texts)] == [
            LIB.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("width", [2, 4])
def test_records_round_trip(spark, width):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = Scratch(spark, "t").path("rec")
    manifest = records.write_records(df, out, PATH, 2, width=width)
    rows = records.read_records(manifest).orderBy("start").collect()
    end = struct.pack("<I", 2)
    want, at = [], 0
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0], r[1] or "")):
        ids = lib(t) + end
        want.append((i, at, len(ids) // 4, ids))
        at += len(ids) // 4
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in rows] == want
    # Shuffled reads through the offset index.
    for m in manifest.collect():
        order = list(range(m.n_docs))[::-1]
        assert [i for i, _ in records.read_at(m.data, m.offsets, order)][::-1] == \
            [i for i, _ in records.read_at(m.data, m.offsets, order[::-1])]
    empty = records.write_records(df.limit(0), Scratch(spark, "t").path("rec"), PATH, 2)
    assert records.read_records(empty).count() == 0


def test_damage_is_noticed(tmp_path):
    import io
    record = records.frame(b"x" * 30)
    assert records.read_frame(io.BytesIO(record)) == b"x" * 30
    for k in range(len(record)):
        bad = bytearray(record)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(record[:-1]))
    assert records.masked(b"") == 0xA282EAD8


def test_runs_cover_a_batch():
    import pyarrow as pa
    texts = ["x" * 10] * 600 + [None, "y" * (records.CHUNK + 1), "", "z" * records.CHUNK, "w"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    runs = list(records._runs(batch))
    assert [v for r in runs for v in r.column(0).to_pylist()] == list(range(len(texts)))
    assert [r.num_rows for r in runs] == [256, 256, 90, 2, 1]
    assert list(records._runs(batch.slice(0, 0))) == []


def test_null_ids_are_kept(spark):
    rows = [(None, "a b"), (None, None), (-1, "c"), (0, ""), (None, "a b"), (5, "long " * 1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    manifest = records.write_records(df, Scratch(spark, "t").path("rec"), PATH, 2)
    got = [(r.doc_id, bytes(r.ids)) for r in records.read_records(manifest).orderBy("start").collect()]
    end = struct.pack("<I", 2)
    assert sorted(x for _, x in got[:3]) == sorted(lib(t) + end for i, t in rows if i is None)
    assert [i for i, _ in got] == [None] * 3 + [-1, 0, 5]
    assert got[3:] == [(i, lib(t) + end) for i, t in rows if i is not None]
    ids = [i for m in manifest.orderBy("part").collect()
           for i, _ in records.read_at(m.data, m.offsets, list(range(m.n_docs)))]
    assert ids == [None] * 3 + [-1, 0, 5]


def test_op6_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_records"](spark, SF).collect()}
    at = 0
    for i, t in docs:
        ids = lib(t) + struct.pack("<I", 2)
        assert got[i] == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_rollup_is_idempotent_and_signed(spark):
    r = rollup.Rollup(spark, Scratch(spark, "t").path("rollup"))
    counts = lambda *rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_tokens bigint, sign string")
    a, b, n = ("s", "en", "v1", 10, "x"), ("s", "de", "v1", 5, "x"), (None, None, "v1", None, "x")
    assert r.totals().count() == 0
    assert r.commit(1, rollup.inserts(counts(a, a, b, n)))
    assert not r.commit(1, rollup.inserts(counts(a)))
    assert r.commit(2, rollup.revisions(counts(a), counts(("s", "en", "v1", 12, "x"))))
    assert r.commit(3, rollup.deletes(counts(b)))
    assert r.commit(4, rollup.inserts(counts(a).limit(0)))
    assert {tuple(x) for x in r.totals().collect()} == {("s", "en", "v1", 2, 22), (None, None, "v1", 1, 0)}
    again = rollup.Rollup(spark, r.root)
    assert again.committed(4) and not again.committed(5)
    # An attempt that died before its rename is no batch.
    rollup.inserts(counts(a)).write.parquet(f"{r.root}/_attempt-dead")
    assert again.totals().count() == 2


def test_a_worker_keeps_one_object_and_reads_texts_in_slices():
    import pyarrow as pa

    from cartable.llm import common
    assert bpe.load(PATH) is bpe.load(PATH)
    bpe.load(PATH, 100)
    assert len(common._HELD) == 1
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1300)])], ["text"])
    parts = list(common.slices([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [512, 512, 276] and not common._HELD
    assert [t for p in parts for t in p.column(0).to_pylist()] == batch.column(0).to_pylist()
