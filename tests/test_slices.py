"""Rebuilt slices: emptied ones, other ones, failures on the way, two rebuilds at a time."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import bank
from paperloom.sources.files import Slices, new_folder, session_documents


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v int")


def found(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_slices_are_replaced_whole(spark):
    table = Slices(spark, new_folder(spark, "slices"), "k")
    with pytest.raises(ValueError):
        table.read()
    table.rebuild(rows_of(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4)]), rows_of(spark, [("a", 0), ("b", 0), (None, 0), ("empty", 0)]))
    assert found(table) == [("a", 1), ("a", 2), ("b", 3), (None, 4)]
    # b is emptied, c is new, rows of a aren't asked for
    again = rows_of(spark, [("a", 9), ("c", 5)])
    for _ in range(2):
        table.rebuild(again, rows_of(spark, [("b", 0), ("c", 0), ("c", 0)]))
        assert found(table) == [("a", 1), ("a", 2), ("c", 5), (None, 4)]
    table.rebuild(rows_of(spark, [(None, 7)]), rows_of(spark, [(None, 0)]))
    table.vacuum()
    assert found(table) == [("a", 1), ("a", 2), ("c", 5), (None, 7)]
    table.rebuild(rows_of(spark, []), rows_of(spark, [(x, 0) for x in ("a", "b", "c", None, "empty")]))
    table.vacuum()
    assert found(table) == []


def test_readers_see_a_rebuild_whole_or_not_at_all(spark, monkeypatch):
    table = Slices(spark, new_folder(spark, "slices"), "k")
    table.rebuild(rows_of(spark, [("a", 1)]), rows_of(spark, [("a", 0)]))
    broken = rows_of(spark, [("a", 2)]).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.rebuild(broken, rows_of(spark, [("a", 0)]))
    assert found(table) == [("a", 1)]
    other = Slices(spark, table.path, "k")
    monkeypatch.setattr(other, "_latest", lambda: -1)
    with pytest.raises(RuntimeError):
        other.rebuild(rows_of(spark, [("a", 3)]), rows_of(spark, [("a", 0)]))
    assert found(table) == [("a", 1)]


def test_analytics_of_odd_sessions(spark):
    totals = spark.createDataFrame([(1, 2, 3, 2, 33.3), (2, 1, 0, 0, 0.0)], "session_id long, total_papers long, total_questions long, unique_questions long, repeat_rate double")
    levels = spark.createDataFrame([(1, "high", 2), (1, "low", 0)], "session_id long, level string, n long")
    weightage = spark.createDataFrame([(1, 0, "a", 1, 5, 33.3, 50.0), (1, 1, "b", 2, 5, 66.7, 50.0), (2, 0, "a", 0, 0, 0.0, 0.0)], "session_id long, topic_idx int, topic string, occurrences long, marks long, occurrence_share double, marks_share double")
    trend = spark.createDataFrame([(1, 2024, 1), (1, 2023, 2)], "session_id long, year int, occurrences long")
    got = {r.session_id: r.analytics_json for r in session_documents(bank.analytics(totals, levels, weightage, trend)).collect()}
    assert got[1] == (
        '{"total_papers":2,"total_raw_questions":3,"total_unique_questions":2,"repeat_rate":33.3,"priority_distribution":{"critical":0,"very_high":0,"high":2,"medium":0,"low":0},'
        '"focus_areas":[{"topic_id":"t_1_1","name":"b","count":2,"freq_pct":66.7,"marks_pct":50.0},{"topic_id":"t_1_0","name":"a","count":1,"freq_pct":33.3,"marks_pct":50.0}],'
        '"year_trends":[{"year":2023,"count":2},{"year":2024,"count":1}]}'
    )
    assert '"focus_areas":[{"topic_id":"t_2_0"' in got[2] and got[2].endswith('"year_trends":[]}') and '"critical":0' in got[2]
