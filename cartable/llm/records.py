"""Token-id files: length-delimited binary records and a separate offset index.

A data file is a run of records in ascending ``doc_id`` order::

    record  := header check(header) payload check(payload)
    header  := u64 payload length, its highest bit set if the document has no id
    payload := i64 doc_id (absent without id), then the ids, u16 each (u32 if the
               vocabulary needs it)
    check   := u32 masked CRC-32: rotate right by 15 and add 0xA282EAD8

and its index file holds one u64 per record, the record's offset, so a reader
can seek to any record in any order. All integers are little-endian. A manifest
(Parquet, one row per data file) names the files and their counts.

Tasks write straight to the shared folder through ``pyarrow.fs``; a file's name
holds a fresh uuid and only the manifest row of the attempt that succeeded names
it, so a lost executor or a second attempt leaves an unnamed file, never a torn
one. Readers check both checksums of every record.
"""
from __future__ import annotations

import re
import struct
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import CACHE_CHARS, STABLE_BELOW, TwoAgeCache, text_of
from .common import held

MASK = 0xA282EAD8  # fixed value of the masked-checksum convention
NO_ID = 1 << 63
MANIFEST = "part int, data string, offsets string, width int, n_docs bigint, n_tokens bigint, n_bytes bigint"
CHUNK = 4 << 20
DOCS_AT_ONCE = 256  # documents in a run, fewer if they hold CHUNK bytes
# Documents encoded together, and their bytes: more share more pieces.
DOCS_ENCODED = 8192
BYTES_ENCODED = 8 << 20
WORDS_ASKED = 1 << 14  # in one call of the library, whose memory grows with them
# Words in each age of a worker's cache; two ages of about 200 bytes a word
# bound it near 0.25 GB. A call of the library costs more than a lookup.
PIECES_KEPT = 600_000


def masked(data: bytes) -> int:
    """A checksum stored beside its data is masked, so that a checksum over
    data that holds checksums stays meaningful."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes, has_id: bool = True) -> bytes:
    head = struct.pack("<Q", len(payload) if has_id else len(payload) | NO_ID)
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def record(doc_id: int | None, ids: bytes) -> bytes:
    return frame(ids, False) if doc_id is None else frame(struct.pack("<q", doc_id) + ids)


def read_record(stream) -> tuple[int | None, bytes] | None:
    """Next ``(doc_id, ids as stored)``, or None at the end."""
    if (found := _read(stream)) is None:
        return None
    payload, has_id = found
    return (struct.unpack("<q", payload[:8])[0], payload[8:]) if has_id else (None, payload)


def read_frame(stream) -> bytes | None:
    """Next payload, or None at the end; a torn or changed record raises."""
    found = _read(stream)
    return found and found[0]


def _read(stream) -> tuple[bytes, bool] | None:
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("record header is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    has_id, n = n < NO_ID, n & NO_ID - 1
    body = stream.read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError("record payload is damaged")
    return body[:n], has_id


def filesystem(uri: str):
    """``(filesystem, path)`` of a URI or plain path of the shared store."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


class LibraryEncoder:
    """Ids of the ``tokenizers`` library, which is called once for the words
    that are not in a bounded cache. Texts are cut at single spaces (no pre-token
    crosses one, see :mod:`.bpe`) and each distinct piece is looked at once: its
    first pre-token and what follows have ids of their own, which are often known
    already. New ones go through the library as one text with a special token of
    the vocabulary between them, whose id shows where each one's ids end."""

    def __init__(self, path: str, width: int | None = None):
        import numpy as np
        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = width or (2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4)
        self.kind = np.dtype(f"<u{self.width}")
        added = self.tok.get_added_tokens_decoder()
        self.cut = next(((t.content, i) for i, t in added.items()
                         if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        # A piece's first pre-token; what follows is cut on its own, as the pattern never looks back.
        self.head = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+").match
        self.unsure = re.compile("|".join([f"[{STABLE_BELOW}-\U0010ffff]", *(re.escape(t.content) for t in added.values())])).search
        self.cache = TwoAgeCache(None, PIECES_KEPT)  # words behind a space
        self.tails = TwoAgeCache(None, PIECES_KEPT // 4)  # what follows a word in its piece

    def pack(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        return [np.array(e.ids, dtype=self.kind).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str], lead: str = " ") -> list[bytes]:
        """Ids of each piece with ``lead`` before it."""
        import numpy as np
        if not pieces or self.cut is None:
            return self.pack([lead + p for p in pieces])
        between, cut_id = self.cut
        joined = lead + (between + lead).join(pieces)
        if joined.count(between) != len(pieces) - 1:  # a piece holds the special token itself
            return self.pack([lead + p for p in pieces])
        ids = np.array(self.tok.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.kind)
        ends = self.width * np.append(np.flatnonzero(ids == cut_id), len(ids))
        starts = np.append(0, ends[:-1] + self.width)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def learn(self, cache: TwoAgeCache, words: set[str], lead: str) -> dict[str, bytes]:
        """Ids of ``words``, from the cache's ages or else from the library; they
        are in the young age afterwards, unless they are long."""
        known = {w: v for w in words if (v := cache.get(w) or cache.old.get(w))}
        ask = [w for w in words if w not in known]
        for at in range(0, len(ask), WORDS_ASKED):
            some = ask[at:at + WORDS_ASKED]
            known.update(zip(some, self.pieces(some, lead), strict=True))
        if len(cache) + len(known) > cache.limit:
            cache.old = dict(cache)
            cache.clear()
        cache.update((w, v) for w, v in known.items() if len(w) <= CACHE_CHARS)
        return known

    def distinct(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of each piece with a space before it, and the places of pieces with
        white space at an end: that stands next to a space, so their ids are empty
        and the texts that hold them are to be encoded whole."""
        ids = list(map(self.cache.get, pieces))
        odd, words, tails = [], {}, {}
        for i in [i for i, v in enumerate(ids) if v is None]:
            p = pieces[i]
            if not p or p[0].isspace() or p[-1].isspace():
                odd.append(i)
                ids[i] = b""
            elif p.isalpha() or self.unsure(p):
                words[i] = p
            else:
                n = self.head(p).end()
                words[i] = p[:n]
                if n < len(p):
                    tails[i] = p[n:]
        known = self.learn(self.cache, set(words.values()), " ")
        for i, w in words.items():
            ids[i] = known[w]
        known = self.learn(self.tails, set(tails.values()), "")
        for i, t in tails.items():
            ids[i] += known[t]
        return ids, odd

    def encode(self, texts) -> list[bytes]:
        """Ids of whole texts (strings or an Arrow array), in this encoder's width."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        if not len(texts):
            return []
        cut = pc.split_pattern(texts.fill_null(""), " ")
        flat, ends = cut.values.dictionary_encode(), cut.offsets.to_numpy().astype(np.int64)
        place, firsts = flat.indices.to_numpy(), ends[:-1]
        pieces = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, odd = self.distinct(pieces)
        # A text's first piece has no space before it.
        first = [pieces[k] for k in place[firsts].tolist()]
        flag = np.zeros(len(pieces), bool)
        flag[odd] = True
        flag = flag[place]
        flag[firsts] = [not p or p[-1].isspace() for p in first]
        whole = np.logical_or.reduceat(flag, firsts).tolist()
        begun = iter(self.pack([p for p, w in zip(first, whole, strict=True) if not w]))
        # The other pieces' ids side by side in the order of the texts.
        rows = pa.array(ids, pa.large_binary()).take(pa.array(np.delete(place, firsts)))
        at = np.frombuffer(rows.buffers()[1], np.int64)[:len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
        at = at[ends - np.arange(len(ends))].tolist()
        data = memoryview(rows.buffers()[2] or b"")
        return [(self.pack([texts[i].as_py()])[0] if len(texts[i].as_py() or "") else b"") if w
                else next(begun) + data[a:b] for i, (w, a, b) in enumerate(zip(whole, at, at[1:], strict=False))]


def _encoder(path: str, width: int | None) -> LibraryEncoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
    return held(("library", path, width), lambda: LibraryEncoder(path, width))


def _runs(batch, docs: int = DOCS_AT_ONCE, chunk: int = CHUNK):
    """Slices of a batch of at most ``docs`` rows that end once their texts hold
    ``chunk`` bytes."""
    import pyarrow.compute as pc
    at = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        size += n or 0
        if size >= chunk or i + 1 - at == docs:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def write_records(docs: DataFrame, out_dir: str, path: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text", width: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write records; returns the
    manifest as read back from ``out_dir/manifest``.

    Null or empty texts become records of the end id alone; repeated ids stay,
    ordered by text; an empty table gives an empty manifest; other columns are
    not read. One shuffle: texts range-partitioned by id (splits a hot id range,
    and equal ids by text). Documents without id come first and keep none.
    """
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext
        enc, part = _encoder(path, width), TaskContext.get().partitionId()
        end = end_id.to_bytes(enc.width, "little")
        name = f"{out_dir}/part-{part:05d}-{uuid.uuid4().hex}"
        offset = tokens = docs_n = 0
        data = index = None
        for batch in batches:
            for some in _runs(batch, DOCS_ENCODED, BYTES_ENCODED):
                if data is None:
                    fs, p = filesystem(name)
                    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
                    data, index = fs.open_output_stream(p + ".rec"), fs.open_output_stream(p + ".idx")
                texts = some.column(1)
                if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
                    texts = [text_of(t) for t in texts]
                framed, offsets = [], []
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode(texts), strict=True):
                    ids += end
                    framed.append(record(doc_id, ids))
                    offsets.append(offset)
                    offset, tokens, docs_n = offset + len(framed[-1]), tokens + len(ids) // enc.width, docs_n + 1
                data.write(b"".join(framed))
                index.write(struct.pack(f"<{len(offsets)}Q", *offsets))
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{
                "part": part, "data": name + ".rec", "offsets": name + ".idx", "width": enc.width,
                "n_docs": docs_n, "n_tokens": tokens, "n_bytes": offset}],
                schema=pa.schema([("part", pa.int32()), ("data", pa.string()), ("offsets", pa.string()),
                                  ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                                  ("n_bytes", pa.int64())]))

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    (d.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
     .mapInArrow(run, MANIFEST).write.parquet(f"{out_dir}/manifest"))
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary)`` of every record, ids as
    little-endian unsigned 32-bit integers, ``start`` the ids before it.

    One task per data file, streamed; file offsets are prefix sums over the
    manifest (one row per file)."""
    import numpy as np
    import pyarrow as pa

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # One row per file; a given number of partitions, as the rows are too small
    # for their bytes to tell how many tasks they need.
    files = files.select("data", "width", "start").repartition(max(1, manifest.count()), "data")

    def run(batches):
        for batch in batches:
            for f in batch.to_pylist():
                fs, p = filesystem(f["data"])
                rows, size, at = [], 0, f["start"]
                with fs.open_input_stream(p, buffer_size=CHUNK) as stream:
                    while (found := read_record(stream)) is not None:
                        ids = np.frombuffer(found[1], f"<u{f['width']}").astype("<u4").tobytes()
                        rows.append((found[0], at, len(ids) // 4, ids))
                        at, size = at + len(ids) // 4, size + len(ids)
                        if size > CHUNK:
                            yield _rows(pa, rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(pa, rows)

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _rows(pa, rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
        ["doc_id", "start", "n_tokens", "ids"])


def read_at(data: str, offsets: str, numbers: list[int]) -> list[tuple[int | None, bytes]]:
    """Shuffled read of one file: ``(doc_id, packed ids as stored)`` of the
    records with these numbers, in the given order, by seeking."""
    fs, index = filesystem(offsets)
    out = []
    with fs.open_input_file(index) as idx, fs.open_input_file(filesystem(data)[1]) as rec:
        for k in numbers:
            idx.seek(8 * k)
            rec.seek(struct.unpack("<Q", idx.read(8))[0])
            out.append(read_record(rec))
    return out


def token_records(docs: DataFrame, path: str, end_id: int, out_dir: str) -> DataFrame:
    """Write the files of all documents and read them back."""
    return read_records(write_records(docs, out_dir, path, end_id))
