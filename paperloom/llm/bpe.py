"""Byte-level BPE by a pair occurrence index (operator 8), and the word cache that operators 1, 8 and 10 share.

A text is cut before each space that a non-space follows. No pre-token of the byte-level
pattern crosses such a cut, so the pieces between cuts can be looked up one by one; only pieces
that a worker has not met yet are split by the pattern and encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import SLICE_BYTES, resident, small_batches, trimmed

#: Fixed value: the byte-level pre-token pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces that a worker keeps between batches (about 200 bytes each); beyond it the cache starts anew.
CACHE_PIECES = 600_000
#: Characters of a piece beyond which it isn't kept.
LONG_PIECE = 100
#: New pre-tokens that are merged together at a time, which bounds the index of their pairs.
LEARNED = 20_000

_ODD_SPACE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, by the rule that printable bytes stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            out[chr(spare)] = b
            spare += 1
    return out


class Vocabulary:
    """Pieces and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        self.pieces: dict[int, bytes] = {i: bytes(letters[c] for c in piece) for piece, i in model["vocab"].items()}
        self.added: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.added.items():
            self.pieces[i] = text.encode()
        #: left id << 20 | right id -> (rank, id of the joined piece)
        self.merges: dict[int, tuple[int, int]] = {}
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        self.single = [0] * 256
        for i, piece in self.pieces.items():
            if len(piece) == 1:
                self.single[piece[0]] = i


def pair_indexed_ids(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of each word, all words merged together.

    All words lie in one chain of symbols with a stop between them. The index maps each pair that
    can merge to its positions in the chain. Active ranks are taken in ascending order; each merge
    changes the pairs of its two neighbours, whose positions are then added to their lists. An
    entry whose symbols have changed since is passed over.
    """
    merges, single = vocabulary.merges, vocabulary.single
    stop = -1
    sym: list[int] = [stop]
    starts: list[int] = []
    for word in words:
        starts.append(len(sym))
        sym += [single[b] for b in word]
        sym.append(stop)
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[int, list[int]] = {}
    for p in range(n - 1):
        a, b = sym[p], sym[p + 1]
        if a >= 0 and b >= 0:
            key = a << 20 | b
            if key in index:
                index[key].append(p)
            elif key in merges:
                index[key] = [p]
    active = [(merges[key][0], key) for key in index]
    heapq.heapify(active)
    while active:
        _, key = heapq.heappop(active)
        at = index.pop(key)
        a, b, new = key >> 20, key & 0xFFFFF, merges[key][1]
        at.sort()
        for p in at:
            q = after[p]
            if sym[p] != a or sym[q] != b:
                continue
            far, near = after[q], before[p]
            sym[p], sym[q] = new, -2
            after[p] = far
            before[far] = p
            left, right = sym[near], sym[far]
            if left >= 0:
                k = left << 20 | new
                if k in merges:
                    if k in index:
                        index[k].append(near)
                    else:
                        index[k] = [near]
                        heapq.heappush(active, (merges[k][0], k))
            if right >= 0:
                k = new << 20 | right
                if k in merges:
                    if k in index:
                        index[k].append(p)
                    else:
                        index[k] = [p]
                        heapq.heappush(active, (merges[k][0], k))
    out = []
    for p in starts:
        ids = array("I")
        while sym[p] != stop:
            ids.append(sym[p])
            p = after[p]
        if sys.byteorder == "big":
            ids.byteswap()
        out.append(ids.tobytes())
    return out


class Pieces(dict[str, bytes]):
    """Values of pieces by their text without `lead`. A piece that isn't there is put together from its pre-tokens' values."""

    def __init__(self, lead: str, cache: PieceCache):
        self.lead, self.cache = lead, cache

    def __missing__(self, word: str) -> bytes:
        piece, cache = self.lead + word, self.cache
        # letters after at most one space are one pre-token
        units = [piece] if word.isalpha() else cache.findall(piece)
        value = cache.value([piece.encode()])[0] if len(units) == 1 else b"".join([cache.unit(u) for u in units])
        if len(word) <= LONG_PIECE:
            self[word] = value
        return value


class PieceCache:
    """Values of whole texts, put together from the values of their pieces, which in turn come from pre-tokens.

    value: gives the values (bytes) of a list of pre-tokens. special: texts that count as one unit wherever they stand, with their values.
    most: pieces kept. together: the new pre-tokens of a call are passed to `value` in one list (of LEARNED at most), else one by one.
    """

    def __init__(self, value: Callable[[list[bytes]], list[bytes]], special: dict[str, bytes], most: int = CACHE_PIECES, together: bool = False):
        import regex

        self.value, self.special, self.most, self.together = value, special, most, together
        self.findall = regex.compile(PATTERN).findall
        self.first, self.spaced = Pieces("", self), Pieces(" ", self)
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in special) + ")") if special else None

    def unit(self, unit: str) -> bytes:
        return self.spaced[unit[1:]] if unit[0] == " " else self.first[unit]

    def _runs(self, text: str) -> list[str]:
        if self.split_special and any(s in text for s in self.special):
            return self.split_special.split(text)
        return [text]

    def _cut(self, run: str) -> list[str]:
        return _CUT.split(run) if _ODD_SPACE.search(run) else run.split(" ")

    def _learn(self, texts: list[str]) -> None:
        """The pre-tokens of pieces that aren't there yet, a list at a time."""
        heads: set[str] = set()
        tails: set[str] = set()
        for text in texts:
            for run in self._runs(text):
                if run not in self.special:
                    words = self._cut(run)
                    heads.add(words[0])
                    tails.update(words)
        new: set[str] = set()
        for lead, words in (("", heads.difference(self.first)), (" ", tails.difference(self.spaced))):
            for word in words:
                new.update([lead + word] if word.isalpha() else self.findall(lead + word))
        known = [u for u in new if u and u[0] != " " and u in self.first or u[:1] == " " and u[1:] in self.spaced]
        fresh = [u for u in new.difference(known) if len(u) <= LONG_PIECE]
        for i in range(0, len(fresh), LEARNED):
            part = fresh[i : i + LEARNED]
            for u, value in zip(part, self.value([u.encode() for u in part]), strict=True):
                if u[0] == " ":
                    self.spaced[u[1:]] = value
                else:
                    self.first[u] = value

    def of(self, texts: list[str]) -> list[bytes]:
        """The value of each text, its pieces' values strung together."""
        if len(self.first) + len(self.spaced) > self.most:
            self.first.clear()
            self.spaced.clear()
        if self.together:
            self._learn(texts)
        first, find, special, out = self.first, self.spaced.__getitem__, self.special, []
        for text in texts:
            values: list[bytes] = []
            for run in self._runs(text):
                if run in special:
                    values.append(special[run])
                elif run:
                    words = self._cut(run)
                    if words[0]:
                        values.append(first[words[0]])
                    del words[0]
                    values += map(find, words)
            out.append(b"".join(values))
        return out


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        self.vocabulary = v = Vocabulary(path)
        special = {s: np.uint32(i).astype("<u4").tobytes() for s, i in v.added.items()}
        self.cache = PieceCache(lambda words: pair_indexed_ids(words, v), special, pieces, together=True)
        self.table = [v.pieces.get(i, b"") for i in range(max(v.pieces) + 1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.of(texts)

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str, pieces: int = CACHE_PIECES) -> Codec:
    """One for each worker and file, kept between tasks of this operator."""
    return resident(("codec", path, pieces), lambda: Codec(path, pieces))


def text_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches of about `most` bytes of text, with their texts; null is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)) if len(column) else []
        at, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                part = batch.slice(at, i - at)
                yield part, [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                at, held = i, 0
            held += int(n)
        if at < len(lengths):
            part = batch.slice(at)
            yield part, [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
    trimmed()


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Encodes every whole text, decodes the ids again, and returns both.

    docs: has the columns `key` and `text`; others are passed over, whatever their names.
    Returns key, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (string), one row for each
    input row. Null and empty texts have no ids; a null key stays; repeated rows are encoded each; an
    empty table gives an empty result. No shuffle: each task encodes its own rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, texts in text_slices(batches):
            ids = own.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())],
                names=["key", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", pieces: int = CACHE_PIECES) -> DataFrame:
    """As encode_decode, but with SHA-256 digests made where the ids are, so that no ids leave the worker.

    pieces: how many a worker keeps between batches. Returns key, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex).
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pieces)
        for part, texts in text_slices(batches):
            ids = own.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
