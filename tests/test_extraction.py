"""Whole papers: questions of copies, running numbers, reports of papers without questions."""

from paperloom.operators import extraction

PAPER = "\n".join([
    "SECTION A",
    "Q1. Answer the following:",
    "(a) What is AVL? (10)",
    "(b) Semester exam",
    "(d) What is DFS? [5]",
    "Q3. Explain the hash table.",
    "Q4. Semester exam",
    "Q5. Explain the hash table.",
])


def test_copies_and_running_numbers(spark):
    papers = spark.createDataFrame([(1, 10, PAPER), (1, 11, PAPER), (2, 12, PAPER), (1, 13, ""), (1, 14, None), (1, 15, "Q1. What is a heap?")], "session_id long, paper_id long, text string")
    on, off = extraction.session_questions(papers)
    rows = on.collect()
    assert {(r.paper_id, r.original_id) for r in rows} == {(10, 10), (11, 10), (12, 12), (15, 15)}
    for paper in (10, 11, 12):
        own = sorted((r for r in rows if r.paper_id == paper), key=lambda r: r.ordinal)
        assert [r.id.rsplit("_", 1)[0] for r in own] == [f"rq_{paper}_{n}" for n in range(1, 5)]
        assert [r.question_number for r in own] == ["Q1(a)", "Q1(d)", "Q3", "Q5"] and [r.ordinal for r in own] == [1, 3, 4, 6]
        assert [r.marks for r in own] == [10.0, 5.0, None, None] and own[2].id[-8:] == own[3].id[-8:]
        gone = sorted((r for r in off.collect() if r.paper_id == paper), key=lambda r: r.ordinal)
        assert [r.id.rsplit("_", 1)[0] for r in gone] == [f"rj_{paper}_2", f"rj_{paper}_5"]
        assert {(r.confidence, r.reason) for r in gone} == {(20, "2-word block does not start with action verb")}


def test_reports(spark):
    pages = [(1, 1, PAPER, 0, None), (1, 2, "", 1, "Q6. Explain the stack machine."), (2, 1, "", 0, ""), (3, 1, None, 0, None), (3, 2, None, 1, None), (4, 1, "", 1, "Q1. Define RAM")]
    found = {r.paper_id: r for r in extraction.reports(spark.createDataFrame(pages, "paper_id long, page_no int, text string, image_count int, ocr_text string")).collect()}
    one = found[1]
    assert (one.page_count, one.method, one.question_count, one.sections_found) == (2, "hybrid", 5, 1)
    assert [q.number for q in one.questions] == ["Q1", "Q3", "Q4", "Q5", "Q6"] and one.questions[0].section == "SECTION A"
    assert [(s.number, s.marks) for s in one.questions[0].subquestions] == [("Q1(a)", 10.0), ("Q1(b)", None), ("Q1(d)", 5.0)]
    assert one.warnings == ["Warning: Missing subquestion c in Q1.", "Warning: Missing question Q2."]
    assert one.text == PAPER + "\n\nQ6. Explain the stack machine."
    for paper, pages in ((2, 1), (3, 2)):
        blank = found[paper]
        assert (blank.page_count, blank.method, blank.question_count, blank.sections_found, blank.questions) == (pages, "text", 0, 0, [])
        assert blank.warnings[0] == "No questions found." and len(blank.warnings) == pages
    assert (found[4].method, found[4].question_count, found[4].warnings) == ("ocr", 1, [])


def test_papers_are_read_in_one_pass(spark):
    """Headers without questions, labels outside of questions, warnings and gaps come with the questions: one parse and one join, and what was found by steps of their own."""
    import random

    from pyspark.sql import functions as F

    from paperloom.operators import segmentation as S

    rng = random.Random(3)
    lines = ["SECTION A", "SECTION B", "(a) x", "(b) y", "(b) z", "(i) u", "more of it", "", "Page 2 of 3", "Short Answer Questions"]
    texts = ["SECTION A\n(a) alone\n(b) too\nSECTION B", "\n\n", "no question\n(c) at all", "Page 1 of 2"]
    texts += ["\n".join(rng.choice(lines) if rng.random() < 0.6 else f"Q{rng.randint(1, 12)}. Explain it. ({rng.randint(1, 9)} marks)" for _ in range(rng.randint(1, 14))) for _ in range(60)]
    papers = spark.createDataFrame(list(enumerate(texts)), "paper_id long, text string")
    pages = papers.select("paper_id", F.lit(1).alias("page_no"), "text", F.lit(0).alias("image_count"), F.lit("").alias("ocr_text"))
    found = extraction.reports(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("MergeJoin") + plan.count("HashJoin") == 1
    got = {r.paper_id: r for r in found.collect()}
    node_rows, rows = S.parsed(papers)
    by = lambda df, column: {r.paper_id: r[column] for r in df.collect()}
    sections = by(S.sectioned(S.paper_lines(papers)).groupBy("paper_id").agg(F.count_if("is_header").alias("n")), "n")
    inline = by(rows.filter("warning is not null").groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "warning"))).alias("w")), "w")
    gaps, nested, few = by(S.missing_mains(rows), "warning"), by(S.nested(node_rows), "questions"), by(S.sanity_warnings(papers.select("paper_id", F.lit(1).alias("page_count")), node_rows), "warnings")
    assert len(gaps) > 5 and len(inline) > 2 and set(got) == set(range(len(texts)))
    for i, r in got.items():
        assert (r.questions, r.question_count, r.sections_found, r.text) == (nested.get(i, []), len(nested.get(i, [])), sections.get(i, 0), texts[i])
        assert r.warnings == [w.warning for w in inline.get(i, [])] + ([gaps[i]] if i in gaps else []) + few[i]
