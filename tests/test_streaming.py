from paperloom.operators.quality import validate
from paperloom.sources.exam import document_lines
from paperloom.streaming.intake import follow


def test_lines_are_validated_once(spark, sf, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    lines = document_lines(spark, sf)
    for part in (0, 1):
        lines.filter(f"doc_id % 2 = {part}").write.mode("append").parquet(source)
        for _ in range(2):
            follow(spark, source, out, progress).awaitTermination()
    names = ["doc_id", "line_no", "status", "confidence", "reason"]
    got = spark.read.parquet(out).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, validate(lines, "line").select(*names).collect()))
