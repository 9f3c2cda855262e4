"""Validated questions and their split and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import validation as V


def validate(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds confidence, status and reason. Each step is a column of its own, so that no check is made twice."""
    t, tokens = F.col("_t"), F.col("_tokens")
    rows = rows.withColumn("_t", F.trim(F.coalesce(F.col(text), F.lit("")))).withColumn("_tokens", V.words(t))
    rows = rows.withColumns({"_failed": F.coalesce(V.garbage_check(t, tokens), V.length_check(t, tokens), V.word_check(tokens), V.blacklist(t)), "_points": V.confidence(t, tokens)})
    rows = rows.withColumn("_verdict", V.verdict(F.col("_points")))
    failed = F.col("_failed").isNotNull()
    found = F.struct(
        F.when(failed, F.col("_failed.confidence")).otherwise(F.col("_points")).alias("confidence"),
        F.when(failed, "rejected").otherwise(F.col("_verdict.status")).alias("status"),
        F.when(failed, F.col("_failed.reason")).otherwise(F.col("_verdict.reason")).alias("reason"),
    )
    # a filter on what comes out of explode stays above it; below, Spark would write every check into it once more
    rows = rows.withColumn("_found", F.explode(F.array(found)))
    return rows.withColumns({c: F.col(f"_found.{c}") for c in ("confidence", "status", "reason")}).drop("_t", "_tokens", "_failed", "_points", "_verdict", "_found")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those that go on (accepted or for review), and the rejected ones."""
    return rows.filter("status != 'rejected'"), rows.filter("status = 'rejected'")


def dealt(rows: DataFrame) -> DataFrame:
    """`kind` of each row, raw or rejected: where both go on to one place, rows are judged once."""
    return rows.withColumn("kind", F.when(F.col("status") == "rejected", "rejected").otherwise("raw"))


def report(rows: DataFrame, by: str) -> DataFrame:
    """Extracted, accepted (review included), rejected and mean confidence of each paper."""
    mean = F.floor(F.avg("confidence") * 10 + 0.5) / 10
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("status") != "rejected").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.coalesce(mean, F.lit(0.0)).alias("mean_confidence"))
