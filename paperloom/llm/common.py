"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: A word: a run of characters other than space and the five ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: UTF-8 bytes of text that a task works on at a time, whatever the batch holds.
SLICE_BYTES = 3_000_000

#: Rows and bytes of an Arrow batch.
ARROW_ROWS, ARROW_BYTES = 1_000, "8m"

#: A side is broadcast only below this many bytes, counted before the join.
BROADCAST_BYTES = 8_000_000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


_RESIDENT: dict[object, object] = {}


def resident(key: object, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task. It keeps one thing: workers live through all stages of an application, and
    what an earlier operator has left is given up, its memory included, before another one's is made."""
    if key not in _RESIDENT:
        released()
        _RESIDENT[key] = make()
    return _RESIDENT[key]  # type: ignore[return-value]


def released() -> None:
    """Gives up what the worker keeps and returns free memory to the system."""
    _RESIDENT.clear()
    gc.collect()
    trimmed()


def trimmed() -> None:
    """Free memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


_LIBC = ctypes.CDLL(None)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder that the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named in spark.checkpoint.dir. Where that is unset, one of this machine under a local master, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-"))
    return context.getCheckpointDir()


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, which goes when the driver ends; data is written to folders below it."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """A folder of our own that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def text_column(df: DataFrame, name: str = "text") -> DataFrame:
    """The null text counts as the empty one."""
    return df.withColumn(name, F.coalesce(F.col(name), F.lit("")))


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes; a longer text is a range of its own."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield at, i
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)


def lowered(text: bytes) -> bytes:
    """A-Z to a-z, all other bytes as they are."""
    return text.translate(_LOWER)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit values (xor-shift multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def broadcast_if_small(df: DataFrame, row_bytes: int, rows: int) -> DataFrame:
    """Broadcast behind a check of its size; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
