"""Byte-level BPE with a contiguous rank array.

A word's bytes are parts that lie side by side. ``ids`` holds the part at each
boundary and ``ranks`` the merge rank of each part with its right neighbour.
The smallest rank (leftmost on ties) is found by scanning the array, the
boundary between the two parts is deleted, and only the two neighbouring ranks
are looked up again. Words are short, so scanning a contiguous array beats a
heap; a run of over ``SCAN_MAX`` parts (text without spaces) goes through a
heap with the same order of merges, so its cost stays below quadratic.

Texts are cut at single spaces first: no pre-token crosses such a space, so the
ids of each piece can be kept and reused. A piece of several pre-tokens (a word
with punctuation or line breaks) is put together from its words' kept ids. A text
with two white spaces side by side, of which one is a space, is encoded whole by
the same code.
"""
from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import regex

from .common import held

# The pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Below this code point the letter and number classes are the same in every
# Unicode version; above it the vocabulary file's own pre-tokenizer decides.
STABLE_BELOW = "԰"
SCAN_MAX = 128
NO_RANK = 1 << 30
CACHE_PIECES = 150_000
CACHE_CHARS = 64  # longer pieces and words are not kept
_UNSURE = re.compile(r" \s|\s ")


def byte_chars() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabulary files: printable
    Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TwoAgeCache(dict):
    """Piece -> packed ids, bounded: when the young age is full it becomes the
    old one, from which pieces in use come back; the rest is forgotten."""

    def __init__(self, make, limit: int = CACHE_PIECES):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_CHARS:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    """Encoder and decoder for one byte-level BPE vocabulary file (JSON)."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        # Rank of a pair (left id << 32 | right id), and the id each rank makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        # Rank of two bytes side by side (left << 8 | right).
        self.byte_rank = [self.rank.get(a << 32 | b, NO_RANK) for a in self.byte_id for b in self.byte_id]
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) \
            if self.special else None
        self._words = regex.compile(PATTERN)
        self._pre = Tokenizer.from_file(path).pre_tokenizer
        self._cache = TwoAgeCache(lambda piece: self._pack(" " + piece), cache_pieces)
        self._kept = TwoAgeCache(self._word, cache_pieces // 4)  # words of pieces of several words

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _UNSURE.search(text):
            return self._pack(text)
        pieces = text.split(" ")
        first = self._pack(pieces[0]) if pieces[0] else b""
        if len(pieces) == 1:
            return first
        if not pieces[0] or not pieces[-1]:  # a space at either end stands next to no second space
            return self._pack(text)
        return first + b"".join(map(self._cache.__getitem__, pieces[1:]))

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        table = self.token_bytes
        return b"".join(map(table.__getitem__, _ints(ids))).decode("utf-8", "replace")

    def _pack(self, text: str) -> bytes:
        if self._special is None or self._special.search(text) is None:
            return self._pack_part(text)
        return b"".join(self._pack_part(part) if special is None else _bytes(array("I", [special]))
                        for part, special in self._parts(text))

    def _pack_part(self, part: str) -> bytes:
        if part.isascii() or max(part) < STABLE_BELOW:
            words = self._words.findall(part)
        else:
            words = [part[a:b] for _, (a, b) in self._pre.pre_tokenize_str(part)]
        if len(words) == 1:
            return self._word(words[0])
        return b"".join([self._cache[w[1:]] if w[0] == " " and w[1:].isalpha() else self._kept[w] for w in words])

    def _word(self, word: str) -> bytes:
        return _bytes(array("I", self.word(word.encode())))

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        if self._special is not None:
            for m in self._special.finditer(text):
                if m.start() > at:
                    yield text[at:m.start()], None
                yield "", self.special[m[0]]
                at = m.end()
        if at < len(text):
            yield text[at:], None

    def word(self, word: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in word]
        if len(ids) > SCAN_MAX:
            return self._long(ids)
        rank, made, first = self.rank.get, self.made, self.byte_rank
        ranks = [first[a << 8 | b] for a, b in zip(word, word[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)
            ids[i] = new = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], NO_RANK)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(a << 32 | b for a, b in zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            low, i, pair = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], alive[j], nxt[i] = self.made[low], False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < n and (p := ids[k] << 32 | ids[nxt[k]]) in rank:
                    heapq.heappush(heap, (rank[p], k, p))
        return [x for x, a in zip(ids, alive, strict=True) if a]


def _ints(packed: bytes) -> array:
    import sys
    out = array("I", packed)
    if sys.byteorder == "big":
        out.byteswap()
    return out


def _bytes(ids: array) -> bytes:
    import sys
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def load(path: str, cache_pieces: int = CACHE_PIECES) -> Bpe:
    """One encoder per Python worker, kept until another operator's tasks run there."""
    return held(("bpe", path, cache_pieces), lambda: Bpe(path, cache_pieces))


def text_of(value) -> str:
    """Text of a string or binary Arrow value; null is the empty text."""
    raw = value.as_py()
    if raw is None:
        return ""
    return raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw


def encode_decode(docs, id_col: str = "doc_id", text_col: str = "text", path: str = "", check: bool = False):
    """Encode each whole text and decode its ids again.

    Returns ``(id, ids binary, n_tokens, decoded string)``, or with ``check``
    a boolean ``round_trip`` (decoded equals text) in place of the decoded text.
    Null and empty texts
    have no ids and decode to the empty text; repeated rows stay; other columns
    are not read. Map only: no shuffle, one batch of texts in memory.
    """
    import pyarrow as pa

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [text_of(t) for t in part.column(1)]
                ids = [bpe.encode(t) for t in texts]
                back = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(ids, pa.binary()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_()) if check
                    else pa.array(back, pa.string())], ["id", "ids", "n_tokens", last])

    kind = docs.schema[id_col].dataType.simpleString()
    last = "round_trip" if check else "decoded"
    return (docs.select(id_col, text_col)
            .mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, {last} {'boolean' if check else 'string'}")
            .withColumnRenamed("id", id_col))
