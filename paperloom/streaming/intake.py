"""Questions validated as files of them come in."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.quality import validate

SCHEMA = "doc_id long, line_no int, line string"


def follow(spark: SparkSession, source: str, out: str, progress: str, schema: str = SCHEMA) -> StreamingQuery:
    """Validates the lines of Parquet files in `source` that have not been seen yet and appends them to `out`, by status.

    Takes all there is and stops; `progress` remembers what was seen, so a run that is broken off or started again leaves
    each line once. The rows are those that the batch validator gives.
    """
    lines = spark.readStream.schema(schema).parquet(source)
    return validate(lines, "line").writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).partitionBy("status").trigger(availableNow=True).start()
