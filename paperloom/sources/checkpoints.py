"""Cutting lineage where a result is read more than once or grows over rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes, counted before the join.
BROADCAST_BYTES = 8_000_000

#: Spark's setting by which the shuffle files of a query are removed when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share, as spark.checkpoint.dir names it. Where that is unset, one of this machine under a local master, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """Under the folder that executors share; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{path}/data"


def cut(df: DataFrame) -> DataFrame:
    """Written to the folder that executors share and read again: computed once, and still there when an executor is lost.

    Columns that repeat few values (wordings and their hashes) take a few bits a row, where a checkpoint of rows holds them all in full.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, "cut")
    # what was shuffled on the way isn't read again; else it stays until the driver happens to collect its garbage
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast behind a count of its rows, so best of a checkpoint; beyond the bound Spark joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
