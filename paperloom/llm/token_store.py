"""Token ids as directly addressable codes (operator 1).

A shard holds the ids of consecutive documents. Each id is split into chunks: level 0 has the lowest
bits of every id, level 1 the next bits of those ids that have any, and so on. A bitmap beside each level
but the last tells which chunks continue, and a directory counts the set bits before every 512th, so
the place of a chunk on the next level is one directory entry and at most eight words away. Any token
is thus read by itself; no block is decoded.

A shard is one row of a Parquet table that Spark writes, so that an executor that is lost costs a task's
rows and leaves no half file behind.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.bpe import PieceCache, byte_letters, text_slices
from paperloom.llm.common import own_folder, resident, small_batches

#: Bits of each level; the last takes what is left of 32.
WIDTHS = (8, 8, 16)
#: Bits between two entries of a rank directory.
STEP = 512
#: Tokens of a shard; a longer document is a shard of its own.
SHARD_TOKENS = 1_000_000

LEVEL = "struct<width: int, n: long, chunks: binary, more: binary, ranks: binary>"
SHARD = f"part int, shard int, first long, n_tokens long, keys array<{{key}}>, offsets binary, levels array<{LEVEL}>"

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_levels(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[dict]:
    """The levels of a shard's ids (unsigned 32-bit)."""
    rest, out = ids.astype(np.uint32), []
    for k, width in enumerate(widths):
        last = k == len(widths) - 1
        chunks = (rest & np.uint32((1 << width) - 1)).astype("<u1" if width <= 8 else "<u2" if width <= 16 else "<u4")
        more = np.zeros(len(rest), bool) if last else (rest >> np.uint32(width)) > 0
        packed = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_POPCOUNT[packed], dtype=np.int64)])
        out.append({"width": width, "n": len(rest), "chunks": chunks.tobytes(), "more": packed.tobytes(), "ranks": ones[:: STEP // 8].astype("<u4").tobytes()})
        rest = rest[more] >> np.uint32(width)
        if not len(rest):
            break
    return out


class Shard:
    """Reads tokens of one shard by position."""

    def __init__(self, levels: list[dict]):
        self.levels = [
            (x["width"], np.frombuffer(x["chunks"], "<u1" if x["width"] <= 8 else "<u2" if x["width"] <= 16 else "<u4"), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4"))
            for x in levels
        ]

    @staticmethod
    def _rank(more: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block = i // STEP
        byte, bit = divmod(i, 8)
        ones = int(ranks[block]) + int(_POPCOUNT[more[block * (STEP // 8) : byte]].sum())
        return ones + (bin(int(more[byte]) & ((1 << bit) - 1)).count("1") if bit else 0)

    def token(self, i: int) -> int:
        """The i-th token; looks at one chunk of each level that it reaches."""
        value, shift = 0, 0
        for width, chunks, more, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not more[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(more, ranks, i), shift + width
        return value

    def tokens(self, i: int, j: int) -> np.ndarray:
        """Tokens i up to j, by one run of chunks on each level."""
        out = np.zeros(j - i, "<u4")
        where: np.ndarray | slice = slice(None)
        shift = 0
        for width, chunks, more, ranks in self.levels:
            if j <= i:
                break
            out[where] |= chunks[i:j].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(more[i >> 3 : (j + 7) >> 3], bitorder="little")[i & 7 : (i & 7) + j - i].astype(bool)
            going = np.flatnonzero(bits)
            where = going if isinstance(where, slice) else where[going]
            if not len(going):
                break
            i, shift = self._rank(more, ranks, i), shift + width
            j = i + len(going)
        return out


def library_encoder(path: str) -> PieceCache:
    """Whole texts encoded by the tokenizers library's model, which gets each distinct pre-token once. One for each worker and file.

    The library's own pre-tokenizer keeps track of offsets, which takes most of its time; the byte-level pattern and letters are applied here instead.
    """

    def make() -> PieceCache:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenize, letters = tokenizer.model.tokenize, {byte: letter for letter, byte in byte_letters().items()}

        def value(words: list[bytes]) -> list[bytes]:
            return [array("I", [t.id for t in tokenize(w.decode("latin-1").translate(letters))]).tobytes() for w in words]

        special = {t.content: array("I", [i]).tobytes() for i, t in tokenizer.get_added_tokens_decoder().items()}
        return PieceCache(value, special)

    return resident(("library", path), make)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 0, key: str = "doc_id") -> None:
    """Encodes every whole text, appends `end_id`, and writes shards in ascending order of `key` to `out`.

    path: of a tokenizers file. docs: has the columns `key` and `text`; others are passed over. Documents are dealt by ranges of the
    key, so that part and shard together give the order; null keys come first. Null and empty texts have the end id
    alone; rows that repeat a key stand beside each other; an empty table writes no shard. A text longer than a shard makes one longer shard.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    kind_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())
    level = pa.list_(pa.struct([("width", pa.int32()), ("n", pa.int64()), ("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("keys", pa.list_(kind_arrow)), ("offsets", pa.binary()), ("levels", level)])
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(path), TaskContext.get().partitionId()
        keys: list = []
        held: list[bytes] = []
        n, first, shard = 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])]).astype("<i8")
            row = {"part": part, "shard": shard, "first": first, "n_tokens": len(ids), "keys": keys, "offsets": offsets.tobytes(), "levels": encode_levels(ids)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for rows, texts in text_slices(batches):
            for k, ids in zip(rows.column(0).to_pylist(), encoder.of(texts), strict=True):
                keys.append(k)
                held.append(ids + end)
                n += len(ids) // 4 + 1
                if n >= SHARD_TOKENS:
                    yield flush()
                    first, shard, n = first + n, shard + 1, 0
                    keys, held = [], []
        if held:
            yield flush()

    rows = docs.select(F.col(key).alias("key"), F.col("text"))
    sorted_rows = rows.repartitionByRange(F.col("key")).sortWithinPartitions("key")
    sorted_rows.mapInArrow(run, SHARD.format(key=kind)).write.mode("overwrite").option("compression", "none").parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """One row for each document of a written store: key, start (tokens before it), n_tokens, ids_crc32.

    Reads each document's run of chunks; the parts' totals, one row a part, are summed up by a window.
    """
    shards = spark.read.parquet(out)
    kind = shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                shard = Shard(row["levels"].as_py())
                offsets = np.frombuffer(row["offsets"].as_py(), "<i8")
                first, part = row["first"].as_py(), row["part"].as_py()
                # all documents of the shard are wanted, so its chunks are read in one run; Shard.token reads one by itself
                ids = memoryview(shard.tokens(0, int(offsets[-1])).tobytes())
                at = (offsets * 4).tolist()
                crcs = [zlib.crc32(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [row["keys"].values, pa.array([part] * len(crcs), pa.int32()), pa.array(offsets[:-1] + first, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())],
                    names=["key", "part", "at", "n_tokens", "ids_crc32"],
                )

    docs = shards.mapInArrow(run, f"key {kind}, part int, at long, n_tokens long, ids_crc32 long")
    # one row for each part of the store: as many as its range partitions
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    joined = docs.join(F.broadcast(before), "part")
    return joined.select("key", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names for checkpoints; it goes when the driver ends."""
    return own_folder(spark, "tokens") + "/store"
