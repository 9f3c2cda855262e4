"""Alignment of two tokenizers' tokens over the same bytes (operator 13).

Each token covers a run of bytes, so a tokenizer's tokens are the rows of an incidence matrix over bytes, kept as compressed sparse rows. Row
products A·Bᵀ by Gustavson's scheme give the pairs of tokens that overlap. Byte offsets where tokens of both end cut the bytes into
groups; the incidence matrices over groups, multiplied likewise, give the pairs that share a group: the links.

Texts are cut at single spaces, at line ends between other characters, and where letters or digits meet a mark that no piece of the second vocabulary joins
to them. Tokens of both vocabularies always end there, so no group crosses a cut. The matrices are built for pieces between cuts that a worker hasn't met yet,
many pieces in one block-diagonal matrix; a document's links are those of its pieces, added up.

Documents are worked through in slices of a bounded size. A slice sends each of its distinct pairs once, with the number of its documents that hold it; sums over all
slices come back to the slice, whose documents keep their pairs as places in the slice's list. So what is shuffled for the corpus-wide counts grows with
slices times distinct pairs, not with links.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import PieceCache, Vocabulary, byte_letters, text_slices
from paperloom.llm.common import own_folder, resident, small_batches

#: Characters of text of a slice; a longer text is a slice of its own.
SLICE = 24_000_000
#: Pieces, and characters in them, that a worker keeps; beyond either it starts anew.
PIECES, PIECE_CHARS = 300_000, 10_000_000
#: Entries of a product that are held at a time.
ENTRIES = 1_000_000
#: Pieces whose matrices are built together.
TOGETHER = 20_000

#: White space beside white space, at an end, or other than spaces and line ends: such texts are cut at single spaces only.
_ODD = re.compile(r"\s\s|\s$|^\s|[^\S \n]")
_CUT = re.compile(r"(?<! )(?= \S)")
#: Marks at which words may be cut.
MARKS = ".,;:!?"


class Csr:
    """A sparse matrix of counts by rows: the columns of row i are cols[starts[i] : starts[i + 1]]."""

    def __init__(self, starts: np.ndarray, cols: np.ndarray, width: int):
        self.starts, self.cols, self.width = starts, cols, width

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Csr:
        """Row i covers the next lengths[i] columns."""
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return cls(starts, np.arange(starts[-1]), int(starts[-1]))

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> Csr:
        """Row i has one entry, in column labels[i]."""
        return cls(np.arange(len(labels) + 1), labels.astype(np.int64), width)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        counts = np.bincount(self.cols, minlength=self.width)
        return Csr(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), rows[np.argsort(self.cols, kind="stable")], len(self.starts) - 1)

    def times(self, other: Csr, most: int = ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, column and value of the entries of self · other, some rows at a time: row i adds up the rows of other that its columns name.

        Rows are taken together up to `most` terms; a row of more terms is taken by itself.
        """
        sizes = np.diff(other.starts)
        terms = np.concatenate([[0], np.cumsum(sizes[self.cols])])
        upto = terms[self.starts]
        i, n = 0, len(self.starts) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
            named = self.cols[self.starts[i] : self.starts[j]]
            rows = np.repeat(np.arange(i, j), np.diff(self.starts[i : j + 1]))
            lengths = sizes[named]
            # places in other.cols of each named row, one after the other
            at = np.arange(int(lengths.sum())) + np.repeat(other.starts[named] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            keys, values = np.unique(np.repeat(rows, lengths) * other.width + other.cols[at], return_counts=True)
            yield keys // other.width, keys % other.width, values
            i = j


def piece_bytes(processor) -> list[bytes]:
    """The bytes of each piece of a sentencepiece model: U+2581 as space, <0xHH> as that byte."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def _summed(piece: np.ndarray, pair: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Each piece's pairs once, pieces ascending, with their times added up."""
    pairs, at = np.unique(pair, return_inverse=True)
    keys, where = np.unique(piece * (len(pairs) + 1) + at, return_inverse=True)
    return np.stack([keys // (len(pairs) + 1), pairs[keys % (len(pairs) + 1)], np.bincount(where, times, len(keys)).astype(np.int64)])


class Pieces:
    """What a worker knows of the pieces that it has met: numbers of tokens, groups, overlaps and links, groups as text, and pairs of ids with how often they link.

    A pair is a's id << 32 | b's id; pairs have numbers of their own.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.tokenize, self.letters = Tokenizer.from_file(path_a).model.tokenize, {byte: letter for letter, byte in byte_letters().items()}
        # strings of special tokens are plain text here
        self.a = PieceCache(lambda words: [array("I", self._ids(w)).tobytes() for w in words], {}, PIECES)
        self.b = SentencePieceProcessor(model_file=path_b)
        vocabulary = Vocabulary(path_a)
        self.bytes_a = [vocabulary.pieces.get(i, b"") for i in range(max(vocabulary.pieces) + 1)]
        self.bytes_b = piece_bytes(self.b)
        pieces = [piece.decode("utf-8", "replace") for piece in self.bytes_b]
        if any(" " in piece.lstrip(" ") or "\n" in piece and piece != "\n" for piece in pieces):
            raise ValueError("a piece of the second vocabulary goes on after a space or over a line's end")
        # letters and digits that a piece joins to a mark aren't cut from it
        tied = re.escape("".join({c for piece in pieces for c in re.findall(rf"([^\W_])[{MARKS}]", piece)}))
        # a run that ends in another letter or digit before a mark or white space, else all up to white space
        self.find = re.compile(rf" ?[^\s{MARKS}]*[^\W_{tied}](?![^\s{MARKS}])| ?\S+|\n").findall
        self.lead = len(self.b.encode("\n"))
        self.len_a, self.len_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])
        # an id as text within its group and at its side's end
        self.inner_a, self.last_a = [f"{i}," for i in range(len(self.bytes_a))], [f"{i}|" for i in range(len(self.bytes_a))]
        self.inner_b, self.last_b = [f"{i}," for i in range(len(self.bytes_b))], [f"{i};" for i in range(len(self.bytes_b))]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[bytes] = []
        #: n_a, n_b, n_groups, n_overlaps, n_links; -1 in the first where a side doesn't give the piece's bytes
        self.sums = np.zeros((0, 5), np.int64)
        self.starts, self.pair_of, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.a.first.clear()
        self.a.spaced.clear()

    def full(self) -> bool:
        return len(self.number) > PIECES or self.chars > PIECE_CHARS

    def _ids(self, word: bytes) -> list[int]:
        return [t.id for t in self.tokenize(word.decode("latin-1").translate(self.letters))]

    def _ids_a(self, piece: str) -> list[int]:
        # letters after at most one space are one pre-token
        if piece.lstrip(" ").isalpha():
            return self._ids(piece.encode())
        return np.frombuffer(self.a.of([piece])[0], "<u4").tolist()

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), TOGETHER):
            self._learn(words[i : i + TOGETHER])

    def _learn(self, words: list[str]) -> None:
        ids_a = [self._ids_a(w) for w in words]
        # the library puts a space in front; of a piece without one, what follows a line's end is taken
        found_b = self.b.encode([w[1:] if w[0] == " " else "\n" + w for w in words], num_threads=1)
        ids_b = [x if w[0] == " " else x[self.lead :] for w, x in zip(words, found_b, strict=True)]
        n, good = len(words), self._whole(words, ids_a, ids_b)
        ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        of_a, of_b = np.repeat(np.arange(n), [len(x) for x in ids_a]), np.repeat(np.arange(n), [len(x) for x in ids_b])
        flat_a, flat_b = np.array([i for x in ids_a for i in x], np.int64), np.array([i for x in ids_b for i in x], np.int64)
        sums = np.zeros((n, 5), np.int64)
        sums[:, 0], sums[:, 1] = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        bytes_a, bytes_b = Csr.of_lengths(self.len_a[flat_a]), Csr.of_lengths(self.len_b[flat_b])
        for rows, _, _ in bytes_a.times(bytes_b.transposed()):
            sums[:, 3] += np.bincount(of_a[rows], minlength=n)
        # a token's group: how many offsets where both end lie before its own end
        ends_a, ends_b = bytes_a.starts[1:], bytes_b.starts[1:]
        ends = np.intersect1d(ends_a, ends_b)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        piece_of_group = np.zeros(len(ends), np.int64)
        piece_of_group[group_a] = of_a
        sums[:, 2] = np.bincount(piece_of_group, minlength=n)
        found = [np.zeros((3, 0), np.int64)]
        for rows, cols, _ in Csr.of_labels(group_a, len(ends)).times(Csr.of_labels(group_b, len(ends)).transposed()):
            piece = of_a[rows]
            sums[:, 4] += np.bincount(piece, minlength=n)
            found.append(_summed(piece, flat_a[rows] << 32 | flat_b[cols], np.ones(len(rows), np.int64)))
        # a piece may lie in two lots of rows
        links = _summed(*np.concatenate(found, axis=1)) if len(found) > 2 else found[-1]
        sums[~np.array(good, bool), 0] = -1
        self._keep(words, sums, links, self._texts(flat_a, flat_b, group_a, group_b, sums[:, 0].clip(0) + sums[:, 1]))

    def _whole(self, words: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Whether both sides give the bytes of each piece."""
        given = [w.encode() for w in words]
        sides = [[b"".join([names[i] for i in x]) for x in ids] for names, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))]
        return [x == w == y for w, x, y in zip(given, *sides, strict=True)]

    def _texts(self, flat_a: np.ndarray, flat_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """Each piece's groups: a1,a2|b1;a3|b2,b3. tokens: of both sides together, by piece."""
        parts: list[str] = []
        for flat, group, inner, last in ((flat_a, group_a, self.inner_a, self.last_a), (flat_b, group_b, self.inner_b, self.last_b)):
            ends = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
            parts += [last[i] if end else inner[i] for i, end in zip(flat.tolist(), ends.tolist(), strict=True)]
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        placed, at, out = [parts[i] for i in order.tolist()], 0, []
        for n in tokens.tolist():
            out.append("".join(placed[at : at + n])[:-1].encode())
            at += n
        return out

    def _keep(self, words: list[str], sums: np.ndarray, links: np.ndarray, texts: list[bytes]) -> None:
        first = len(self.groups)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.chars += sum(map(len, words))
        self.groups += texts
        self.sums = np.concatenate([self.sums, sums])
        self.pairs = np.concatenate([self.pairs, np.setdiff1d(links[1], self.pairs)])
        order = np.argsort(self.pairs)
        self.pair_of = np.concatenate([self.pair_of, order[np.searchsorted(self.pairs, links[1], sorter=order)]])
        self.times = np.concatenate([self.times, links[2]])
        counts = np.bincount(links[0], minlength=len(words))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def words(self, text: str) -> list[str]:
        """The pieces of a space and the text."""
        whole = " " + text
        return [x for x in _CUT.split(whole) if x] if _ODD.search(text) else self.find(whole)


def known_pieces(path_a: str, path_b: str) -> Pieces:
    return resident(("pieces", path_a, path_b), lambda: Pieces(path_a, path_b))


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, that number first."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype("u1")
    return bytes([kind.itemsize]) + values.astype(kind.newbyteorder("<")).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


NUMBERS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")
SLICED = f"slice long, key {{key}}, {', '.join(f'{n} long' for n in NUMBERS)}, groups string, pairs binary, times binary"


class _Slice:
    """The documents of a slice, until all are there."""

    def __init__(self, known: Pieces, digest: bool):
        self.known, self.digest = known, digest
        self.chars, self.keys, self.sums, self.groups, self.held = 0, [], [], [], []

    def add(self, keys: pa.Array, texts: list[str]) -> None:
        known = self.known
        lists = [known.words(t) if t else [] for t in texts]
        known.learn(list(set().union(*lists).difference(known.number)))
        numbers = [list(map(known.number.__getitem__, words)) for words in lists]
        lengths = np.array([len(x) for x in numbers])
        flat, doc = np.concatenate([np.array(x, np.int64) for x in numbers]) if numbers else np.zeros(0, np.int64), np.repeat(np.arange(len(texts)), lengths)
        bad = np.unique(doc[known.sums[flat, 0] < 0])
        fit = ~np.isin(doc, bad)
        flat, doc = flat[fit], doc[fit]
        sums = np.stack([np.bincount(doc, known.sums[flat, k], minlength=len(texts)).astype(np.int64) for k in range(5)], axis=1)
        # each piece of a document once, then its pairs
        keyed, often = np.unique(doc * (len(known.groups) + 1) + flat, return_counts=True)
        doc, flat = keyed // (len(known.groups) + 1), keyed % (len(known.groups) + 1)
        counts = known.starts[flat + 1] - known.starts[flat]
        at = np.arange(int(counts.sum())) + np.repeat(known.starts[flat] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(flat) else np.zeros(0, np.int64)
        keyed = np.repeat(doc, counts) * (len(known.pairs) + 1) + known.pair_of[at]
        order = np.argsort(keyed, kind="stable")
        keyed, times = keyed[order], (known.times[at] * np.repeat(often, counts))[order]
        first = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]])) if len(keyed) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        keyed = keyed[first]
        self.held.append((np.searchsorted(keyed, np.arange(len(texts) + 1) * (len(known.pairs) + 1)), (keyed % (len(known.pairs) + 1)).astype(np.uint32), times))
        gone = set(bad.tolist())
        for i, own in enumerate(numbers):
            whole = b";".join([known.groups[k] for k in own]) if own and i not in gone else b""
            self.groups.append((hashlib.sha256(whole).hexdigest() if whole else "") if self.digest else whole.decode())
        self.keys.append(keys)
        self.sums.append(sums)
        self.chars += sum(map(len, texts))

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """First a row of the slice's distinct pairs and in how many documents each is; then the documents, pairs as places in that list."""
        every = np.concatenate([pairs for _, pairs, _ in self.held])
        counts = np.bincount(every, minlength=len(self.known.pairs))
        there = np.flatnonzero(counts)
        there = there[np.argsort(self.known.pairs[there])]
        place = np.zeros(len(self.known.pairs), np.int64)
        place[there] = np.arange(len(there))
        kind = self.keys[0].type
        names = ["slice", "key", *NUMBERS, "groups", "pairs", "times"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), pa.array([_packed(self.known.pairs[there])], pa.binary()), pa.array([_packed(counts[there])], pa.binary())],
            names=names,
        )
        at = 0
        for keys, sums, (bounds, pairs, times) in zip(self.keys, self.sums, self.held, strict=True):
            n = len(keys)
            ranges = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            columns = [pa.array([_packed(place[pairs[i:j]]) for i, j in ranges], pa.binary()), pa.array([_packed(times[i:j]) for i, j in ranges], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([number] * n), keys, *[pa.array(sums[:, k]) for k in range(5)], pa.array(self.groups[at : at + n], pa.string()), *columns], names=names)
            at += n


def _sliced(docs: DataFrame, path_a: str, path_b: str, key: str, digest: bool, most: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = known_pieces(path_a, path_b), TaskContext.get().partitionId() << 32
        now = _Slice(known, digest)
        for rows, texts in text_slices(batches):
            now.add(rows.column(0), texts)
            if now.chars >= most or known.full():
                yield from now.rows(number)
                number, now = number + 1, _Slice(known, digest)
                if known.full():
                    known.forget()
        if now.keys:
            yield from now.rows(number)

    return docs.select(F.col(key).alias("key"), F.col("text")).mapInArrow(run, SLICED.format(key=kind))


def _pair_rows(sliced: DataFrame) -> DataFrame:
    """slice, at (place in the slice's list), pair, docs"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                values, docs = _unpacked(pairs), _unpacked(times)
                for i in range(0, len(values), 50_000):
                    part = values[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part), pa.array(docs[i : i + len(part)])], names=["slice", "at", "pair", "docs"])

    # the slice's own row is the one without numbers
    return sliced.filter("n_a is null").select("slice", "pairs", "times").mapInArrow(run, "slice long, at int, pair long, docs long")


def pair_counts(pair_rows: DataFrame) -> DataFrame:
    """pair (a's id << 32 | b's id), n (documents that hold it linked), best (n is the highest of a's id, ties included) over the whole corpus."""
    counts = pair_rows.groupBy("pair").agg(F.sum("docs").alias("n"))
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("highest"))
    # a row an id of the first vocabulary
    both = counts.join(highest, F.shiftright("pair", 32) == F.col("a"))
    return both.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", digest: bool = False, most: int = SLICE) -> DataFrame:
    """One row for each input row: key, n_a, n_b (tokens), n_groups, n_overlaps (pairs of tokens that share bytes), n_links (pairs that share a group), n_best, count_sum, groups.

    path_a: a byte-level BPE file, which encodes a space and the text; path_b: a sentencepiece model, which adds that space itself. A pair of ids counts the documents of
    the whole table that hold it linked; n_best: links whose count is their first id's highest; count_sum: counts over links. groups: `a1,a2|b1;a3|b2,b3`, or its SHA-256 where `digest`
    asks for it. Null and empty texts, and those that a vocabulary doesn't give back byte for byte, have zeros and no groups. Null keys stay; rows that
    repeat a key are documents of their own; an empty table gives an empty result; other columns are passed over, whatever their names. A text longer than a slice is a slice of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    folder = own_folder(spark, "alignment")
    _sliced(docs, path_a, path_b, key, digest, most).write.parquet(f"{folder}/sliced")
    sliced = spark.read.parquet(f"{folder}/sliced")
    _pair_rows(sliced).write.parquet(f"{folder}/pairs")
    rows = spark.read.parquet(f"{folder}/pairs")
    counts = pair_counts(rows)
    back = rows.join(counts, "pair").select("slice", "at", "n", "best")
    names = ["key", *NUMBERS, "n_best", "count_sum", "groups"]

    def weigh(own: pa.Table, counted: pa.Table) -> pa.Table:
        n, best = np.zeros(counted.num_rows, np.int64), np.zeros(counted.num_rows, np.int64)
        at = counted.column("at").to_numpy()
        n[at], best[at] = counted.column("n").to_numpy(), counted.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for pairs, times in zip(own.column("pairs"), own.column("times"), strict=True):
            p, t = _unpacked(pairs.as_py()), _unpacked(times.as_py())
            n_best.append(int(t @ best[p]))
            count_sum.append(int(t @ n[p]))
        return own.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).select(names)

    # a slice is bounded, and so are its pairs
    own = sliced.filter("n_a is not null").groupBy("slice")
    found = own.cogroup(back.groupBy("slice")).applyInArrow(weigh, f"key {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, n_best long, count_sum long, groups string")
    return found.withColumnRenamed("key", key)
