"""Exact deduplication by a Golomb-coded exchange of fingerprints (operator 6).

Each partition sends the sorted distinct fingerprints of its texts, Golomb-coded, to the owners of
fingerprint ranges, with a bitmap of those that it holds twice. An owner finds the fingerprints that more than one partition sent
and makes a bitmap over each sender's list. Lists and bitmaps are both in its hands, so it reads the bitmaps there
instead of sending them back, for which the fingerprints would have to be shuffled once more. Only the texts that
a bitmap marks are then grouped by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import text_slices
from paperloom.llm.common import broadcast_if_small, cut, fresh, lowered, small_batches

#: Bits of a fingerprint: at 10^11 texts, one in 2,800 texts that have no copy is checked for nothing.
PRINT_BITS = 48
#: Distinct fingerprints that an owner is to get, about.
OWNER_PRINTS = 200_000


def golomb_encode(values: np.ndarray, low: int) -> tuple[int, bytes, bytes]:
    """Rice parameter, quotients (unary) and remainders of the gaps of ascending values from `low`."""
    gaps = np.diff(values, prepend=np.uint64(low)).astype(np.uint64)
    mean = max(1.0, float(gaps.mean()) * 0.69)
    k = int(np.log2(mean))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary, bitorder="little").tobytes(), np.packbits(bits.ravel(), bitorder="little").tobytes()


def golomb_decode(n: int, k: int, unary: bytes, remainders: bytes, low: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8), bitorder="little") == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = quotients.astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(remainders, np.uint8), bitorder="little")[: n * k].reshape(n, k)
        for j in range(k):
            gaps |= bits[:, j].astype(np.uint64) << np.uint64(j)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    """Ranges of equal width."""
    return (prints >> np.uint64(PRINT_BITS - 24)) * np.uint64(owners) >> np.uint64(24)


def _low(owner: int, owners: int) -> int:
    """The least fingerprint that an owner can get."""
    return -(-(owner << 24) // owners) << (PRINT_BITS - 24)


def _prints(docs: DataFrame, key: str) -> DataFrame:
    """part, row, key, print (PRINT_BITS of the digest), sha (of the lower-cased text) for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for rows, texts in text_slices(batches):
            shas = [hashlib.sha256(lowered(t.encode())).digest() for t in texts]
            prints = [int.from_bytes(s[: PRINT_BITS // 8], "big") for s in shas]
            n = len(shas)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), rows.column(0), pa.array(prints, pa.int64()), pa.array(shas, pa.binary())],
                names=["part", "row", "key", "print", "sha"],
            )
            row += n

    return docs.select(F.col(key).alias("key"), F.col("text")).mapInArrow(run, f"part int, row long, key {kind}, print long, sha binary")


def _suspects(prints: DataFrame, owners: int) -> DataFrame:
    """The distinct fingerprints that occur more than once, as the exchange finds them; each comes once, from its owner."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch.column(0).to_numpy(zero_copy_only=False) for batch in batches]
        names, kinds = ["owner", "n", "k", "unary", "remainders", "twice"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        out = []
        if held:
            mine, counts = np.unique(np.concatenate(held).astype(np.uint64), return_counts=True)
            owner = _owner_of(mine, owners)
            for o in np.unique(owner).tolist():
                own = owner == o
                k, unary, remainders = golomb_encode(mine[own], _low(o, owners))
                out.append((o, int(own.sum()), k, unary, remainders, np.packbits(counts[own] > 1, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)

    def answer(sent: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(int(r.n), int(r.k), r.unary, r.remainders, _low(int(r.owner), owners)) for r in sent.itertuples()]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        several = values[counts > 1]
        # a sender's bitmap: what others have sent as well, and what it holds twice itself
        marked = []
        for r, own in zip(sent.itertuples(), lists, strict=True):
            bitmap = np.isin(own, several, assume_unique=True) | np.unpackbits(np.frombuffer(r.twice, np.uint8), bitorder="little")[: len(own)].astype(bool)
            marked.append(own[bitmap])
        return pd.DataFrame({"print": np.unique(np.concatenate(marked)).astype(np.int64)})

    sent = prints.select("print").mapInArrow(send, "owner int, n long, k int, unary binary, remainders binary, twice binary")
    return sent.groupBy("owner").applyInPandas(answer, "print long")


def exact_groups(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each input row: key, keep_id, group_size, kept, sha (of the lower-cased text).

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest key stays. Null
    text is the empty text; null keys are smaller than all others; of rows that repeat both key and text one
    stays. An empty table gives an empty result; other columns of docs are passed over. Fingerprints only pick
    suspects; texts are grouped by their bytes, combined in each task first, so a text with many copies sends one row a task.
    """
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    prints = cut(_prints(docs, key))
    rows = prints.count()
    suspects = cut(_suspects(prints, max(4, -(-rows // OWNER_PRINTS))))
    n = suspects.count()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, given in text_slices(batches):
            small = [lowered(t.encode()) for t in given]
            prints = [int.from_bytes(hashlib.sha256(t).digest()[: PRINT_BITS // 8], "big") for t in small]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64()), pa.array(small, pa.binary())], names=["key", "print", "norm"])

    whole = docs.select(F.col(key).alias("key"), F.col("text")).mapInArrow(texts, f"key {kind}, print long, norm binary")
    marked = whole.join(broadcast_if_small(suspects, 16, n), "print", "left_semi")
    # by bytes: equal fingerprints of different texts come apart here
    classes = marked.groupBy("norm").agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = cut(classes.filter("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"))
    many = classes.count()
    # the one row that stays where key and text repeat
    winner = prints.join(broadcast_if_small(classes, 72, many), "sha").filter(F.col("key").eqNullSafe(F.col("keep_id")))
    winner = winner.groupBy("sha", "keep_id", "group_size").agg(F.min(F.struct("part", "row")).alias("stays"))
    found = prints.join(broadcast_if_small(winner, 88, many), "sha", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("key").alias(key),
        F.when(alone, F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.struct("part", "row") == F.col("stays"))).alias("kept"),
        "sha",
    )


def drop_copies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows that exact_groups doesn't keep; columns as they were, whatever their names. Cases as in exact_groups."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    groups = cut(exact_groups(docs, key))
    own, k, sha, repeat = fresh(docs, "own_sha", "gone_key", "gone_sha", "gone_repeat")
    gone = groups.filter("not kept").select(F.col(key).alias(k), F.col("sha").alias(sha), F.col(key).eqNullSafe(F.col("keep_id")).alias(repeat)).distinct()
    n = gone.count()
    marked = docs.withColumn(own, F.unhex(F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower), 256)))
    found = marked.join(broadcast_if_small(gone, 80, n), F.col(key).eqNullSafe(F.col(k)) & (F.col(own) == F.col(sha)), "left")
    rest = found.filter(F.col(sha).isNull())
    # rows that repeat the key and the text of the row that stays
    once = found.filter(F.col(repeat)).dropDuplicates([key, own])
    return rest.unionByName(once).select(*docs.columns)
