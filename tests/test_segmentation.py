"""The parse stays within one deal of papers; what is judged is judged once."""

from paperloom.operators import quality, segmentation


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_papers_are_dealt_once(spark):
    """All windows and groups over a paper's lines come after one shuffle, and nothing is written or joined."""
    papers = spark.createDataFrame([(1, "SECTION A\nQ1. Explain this. (5 marks)\n(a) odd\n(b) even"), (2, None)], "paper_id long, text string")
    node_rows, _ = segmentation.parsed(papers)
    text = plan(segmentation.leaves(node_rows))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    assert [r.question_number for r in segmentation.leaves(node_rows).orderBy("line_no").collect()] == ["Q1(a)", "Q1(b)"]


def test_sections_by_segments(spark):
    """Names are appended to the keyword header in force only; numbers start again in each segment."""
    text = "Short Questions\nQ1. One\nSECTION A\nLong Answer Questions\nQ1. Two\nQ1. Again\nPART B\nQ5. Three\nQ4. Less"
    rows = segmentation.parsed_lines(spark.createDataFrame([(1, text)], "paper_id long, text string")).filter("number is not null").orderBy("line_no").collect()
    assert [(r.number, r.section) for r in rows] == [(1, "Short Questions"), (1, "SECTION A - Long Answer Questions"), (5, "PART B")]


def test_rows_are_judged_once(spark):
    """A filter on the verdict stays above the checks, so they aren't written into it again."""
    rows = quality.validate(spark.createDataFrame([("Explain the bolt.",), ("Semester 1",)], "text string"))
    text = rows.filter("status = 'rejected'")._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Filter") < text.index("Generate")
    assert sorted(r.kind for r in quality.dealt(rows).collect()) == ["raw", "rejected"]
