"""From raw documents to token ids in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe, exact_dedup, importance, mixing, simhash
from paperloom.llm.common import own_folder, remove

#: Pieces that a worker keeps in the last stage; workers live on through all stages, so it holds fewer than a run of that stage alone.
CACHED_PIECES = 120_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against those labelled good keeps."""
    return importance.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are alike by 0.8 or more."""
    return simhash.drop_near_copies(docs, similarity=0.8, shingle=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that is taken twice has two rows."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), pieces=CACHED_PIECES)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mix),
    ("BPE encoding", tokens),
]

#: A trained model, a hash sampling and a tokenizer decide the rows, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage has written goes when the next one is done, the last result when the driver ends.

    Null and empty texts, null keys, repeated rows, other columns and an empty table go through as the stages' operators say: texts without words are left by
    the classifier as middling, are copies of each other, have no near copies and are not mixed, so none of them reaches the last stage.
    """
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), own_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
