"""Scalars, validator and parser on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import quality, segmentation


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text,confidence,status",
    [
        ("Explain Round Robin Scheduling.", 92, "accepted"),
        ("Design a memory management system.", 92, "accepted"),
        ("Compare SRAM and DRAM.", 92, "accepted"),
        ("Consider a system with 4 page frames. What is the number of page faults?", 100, "accepted"),
        ("Define CPU scheduling.", 92, "accepted"),
        ("Define RAM", 80, "accepted"),
        ("Answer all the questions", 12, "rejected"),
        ("Answer any four questions", 12, "rejected"),
        ("Full Marks: 20", 12, "rejected"),
        ("Time: 1.5 Hours", 30, "rejected"),
        ("Semester: 4th", 20, "rejected"),
        ("[Subquestions Only]", 20, "rejected"),
        ("Subject Code: CS20002", 5, "rejected"),
        ("Page 1 of 5", 15, "rejected"),
        ("pg. 2", 0, "rejected"),
        ("r: lld", 0, "rejected"),
        ("ct N.DC} Opcr.ting Syst ul", 0, "rejected"),
        ("och (sl:- CSE.IT. CSCE", 0, "rejected"),
        ("|||||", 15, "rejected"),
        ("a b c d", 15, "rejected"),
        ("", 0, "rejected"),
        (None, 0, "rejected"),
    ],
)
def test_validator(spark, text, confidence, status):
    row = quality.validate(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.confidence, row.status) == (confidence, status)


def test_cleaning(spark):
    cases = {"Explain    Round Robin   Scheduling.": "Explain Round Robin Scheduling.", "What is paging? \n How does it work?": "What is paging? How does it work?", "DRAM....": "DRAM.", "memory????": "memory?", "paging |": "paging", "_ paging _": "paging", None: ""}
    assert values(spark, cases, T.cleaned_question) == list(cases.values())
    numbers = {"Q1.": "Q1", "1.": "1", "1:": "1", " (a) ": "(a)", "1(a).": "1(a)"}
    assert values(spark, numbers, T.normal_number) == list(numbers.values())


def test_repair_and_marks(spark):
    cases = {"1, What": "1. What", "iv: x": "iv. x", "Q4: a": "Q4. a", "Q l": "Q 1", "for 1O marks": "for 10 marks", "[1O]": "[10]", "l) a": "1) a", "2nd": "2.", "ivs": "iv."}
    assert values(spark, cases, T.repaired_line) == list(cases.values())
    got = values(spark, ["a [2x5]", "b (10 marks)", "c [5]", "d 10 marks", "e (3) f (3)", "none"], T.marks)
    assert [(m.value, m.a, m.b, m.pattern) for m in got] == [(10.0, 2, 5, "[2x5]"), (10.0, None, None, "(10 marks)"), (5.0, None, None, "[5]"), (10.0, None, None, "10 marks"), (3.0, None, None, "(3)"), (None, None, None, None)]
    assert got[4].rest == "e  f "


def test_markers_and_labels(spark):
    got = values(spark, ["3", "a", "B", "iv", "IV", "i", "X", "Iv", "abc", "xx"], T.marker)
    assert [(m.type, m.value) for m in got] == [("num", 3), ("alpha_lower", 1), ("alpha_upper", 2), ("roman_lower", 4), ("roman_upper", 4), ("overlap_lower", 1), ("overlap_upper", 10), (None, None), (None, None), ("roman_lower", 20)]


def labels(spark, *given):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "line_no int, label string")
    events = rows.agg(F.sort_array(F.collect_list(segmentation.label_events(F.col("label"), F.col("line_no")))).alias("events"))
    placed = events.select(segmentation.placed_labels(F.lit("Q1"), F.col("events")).alias("placed")).first().placed
    return [(x.sub_ord, x.subsub_ord, x.label, x.warning) for x in placed]


def test_levels_and_repairs(spark):
    assert [x[:3] for x in labels(spark, "a", "i", "ii", "b")] == [(1, 0, "a"), (1, 1, "i"), (1, 2, "ii"), (2, 0, "b")]
    assert [x[:3] for x in labels(spark, "h", "i", "j")] == [(1, 0, "h"), (2, 0, "i"), (3, 0, "j")]
    twice = labels(spark, "a", "b", "b")
    assert twice[2][:3] == (3, 0, "c") and "Corrected duplicate 'b' to 'c'" in twice[2][3]
    assert labels(spark, "a", "c")[1][3] == "Warning: Missing subquestion b in Q1."
    assert labels(spark, "c")[0][3] is None


def test_labels_of_other_kinds(spark):
    # a label of no kind opens a series that goes on with others of no kind
    assert [x[:3] for x in labels(spark, "abc", "1", "xyz", "2")] == [(1, 0, "abc"), (1, 1, "1"), (2, 0, "xyz"), (2, 1, "2")]
    # a third kind below opens a new lower series, whose numbers start anew
    assert [x[:3] for x in labels(spark, "1", "a", "i", "A", "2")] == [(1, 0, "1"), (1, 1, "a"), (1, 2, "i"), (1, 3, "A"), (2, 0, "2")]
    assert labels(spark, "i", "v")[1] == (2, 0, "v", "Warning: Missing subquestion ii, iii, iv in Q1.")
    assert labels(spark, "w", "x")[1] == (2, 0, "x", None)


def test_wide_gaps_make_short_warnings(spark):
    assert labels(spark, "1", "3000000")[1][3] == "Warning: Missing subquestion 2 to 2999999 (2999998 labels) in Q1."
    assert labels(spark, "1", "12")[1][3] == "Warning: Missing subquestion " + ", ".join(map(str, range(2, 12))) + " in Q1."
    assert labels(spark, "1", "99999999999")[1][3] is None  # no number that fits
    _, missing = parse(spark, "Q1. a\nQ2000000000. b")
    assert missing == ["Warning: Missing questions Q2 to Q1999999999."]


def parse(spark, text):
    nodes, rows = segmentation.parsed(spark.createDataFrame([(1, text)], "paper_id long, text string"))
    found = [(r.question_number, r.text, r.marks, r.section) for r in nodes.orderBy("main_ord", "sub_ord", "subsub_ord").collect()]
    return found, [r.warning for r in segmentation.missing_mains(rows).collect()]


def test_flat_and_nested_papers(spark):
    flat, _ = parse(spark, "SECTION A\nQ1. Define Stack. (5 marks)\nQ2. Explain Queue. [10 Marks]\nQ3. What is DFS? (20 marks)")
    assert flat == [("Q1", "Define Stack", 5.0, "SECTION A"), ("Q2", "Explain Queue", 10.0, "SECTION A"), ("Q3", "What is DFS?", 20.0, "SECTION A")]
    nested, _ = parse(spark, "Q1. Answer the following:\n(a) What is AVL? (10)\n(b) What is DFS? [5]")
    assert [x[:3] for x in nested] == [("Q1", "Answer the following", None), ("Q1(a)", "What is AVL?", 10.0), ("Q1(b)", "What is DFS?", 5.0)]
    mixed, _ = parse(spark, "SECTION B\nQ1\na) Define Stack [5 Marks]\nb) Explain Queue [5 Marks]\nQ2\na) reverse singly linked list [10]")
    assert [x[0] for x in mixed] == ["Q1", "Q1(a)", "Q1(b)", "Q2", "Q2(a)"]
    dealt, _ = parse(spark, "Q1. Write on: [2x5]\n(a) x\n(b) y\n(c) z\n(d) u\n(e) v")
    assert [x[2] for x in dealt] == [10.0] + [2.0] * 5


def test_noisy_paper(spark):
    text = "SECTION A\nShort Answer Questions\n1, What is a database transaction? (10 marks)\n2, Explain two-phase locking protocol. [1O]\npg. 2\nSECTION B\nLong Answer Questions\nQ4: Describe it. [20]\nQ5. (a) First (10)\n(b) Second [10m]"
    found, missing = parse(spark, text)
    assert [x[0] for x in found] == ["Q1", "Q2", "Q4", "Q5", "Q5(a)", "Q5(b)"]
    assert [x[2] for x in found][:3] == [10.0, 10.0, 20.0]
    assert {x[3] for x in found} == {"SECTION A - Short Answer Questions", "SECTION B - Long Answer Questions"}
    assert missing == ["Warning: Missing question Q3."]


ODD = ["", " ", "Q1. Explain the ring. (5 marks)", "[2 x 7] a (3) b 4 marks", "two (3m) and [2x7]", "10 m", "x5 marksy", "see (4 ) or 5m.", "1o marks (1O)", "l. one", "Q12: a", "iv, b", "2nd c", "3s d", "xs e", "Question l f", "Ql g",
    "a  b\tc\n\rd", "a | b ~ c", "_ a ^", "wait... what?? no!! --- yes", "..", "\x0ba\x0c", "Page 2 of 3", " roll no 7", "All  the Best!", "MAX marks 70", "Section exam NITR", "Answer all the questions", "the best of luck to all", "Choose any one", "selects", "time : 3 h"]


def test_gates_change_nothing(spark):
    """Texts that a gate keeps from patterns are as the patterns would leave them."""

    def repaired(x):
        for pattern, to in T.REPAIRS:
            x = F.regexp_replace(x, pattern, to)
        return x

    def cleaned(x):
        x = F.regexp_replace(x, r"[\n\r]", " ")
        x = F.regexp_replace(F.regexp_replace(x, r"\s+[\\|_~^]\s+", " "), r"^[\\|_~^]\s+|\s+[\\|_~^]$", " ")
        for mark, least in ((".", 3), ("?", 2), ("!", 2), ("-", 3)):
            x = F.regexp_replace(x, rf"[{mark}]{{{least},}}", mark)
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    noise = lambda x: F.trim(x).rlike(rf"(?i)^\s*({T.NOISE_STARTS})|" + "|".join(r"\s+".join(b.split()) for b in T.BANNERS))
    for plain, gated in ((repaired, T.repaired_line), (cleaned, T.cleaned_question), (noise, T.is_noise_line)):
        assert values(spark, ODD, plain) == values(spark, ODD, gated)
    assert all(any(word in p for word in T.INSTRUCTION_WORDS) for p in T.INSTRUCTIONS)
    for x in ("answer all", "attempt the following", " choose any", "select one", "answer"):
        assert values(spark, [x], T.is_instruction) == [True]


def test_marks_are_sought_once(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "x string").repartition(2).withColumn("n", F.rand())
    both = T.with_marks(rows.withColumn("y", F.concat("x", F.lit(""))), "y", "m").withColumn("want", T.marks(F.col("y")))
    assert all(r.m == r.want for r in both.collect())
    found = T.with_marks(rows, "x", "m").select("m.value", "m.a", "m.b", "m.pattern", "m.rest")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"regexp_extract(x") == 3


def test_plain_wordings_are_as_by_all_patterns(spark):
    """The way for plain words gives what the patterns give."""
    import re

    texts = ["Explain the red rod.", "explain", "explain.", "a. b", "a b..", "a b ..", " a b", "a b ", "a  b", "q 3 a b", "q a b", "(a) b c", "a) b c", "a-b c", "a\tb", "a b.\n", "a b. c", ".", ". a b", "", "Ärger mit b", "x y?", "İ a", "a b . ."]
    got = [r.n for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", T.normal_text(F.col("t")).alias("n")).orderBy("i").collect()]

    def plain(x):
        x = x.lower()
        for p in T.PREFIXES:
            x = re.sub(p, "", x)
        x = re.sub(r"\s+", " ", x).strip(" ")
        return re.sub(r"[^\w\s()]", "", x).strip(" ")

    at = texts.index("İ a")
    assert [x for i, x in enumerate(got) if i != at] == [plain(x) for i, x in enumerate(texts) if i != at]


def test_blank_lines_are_no_garbage(spark, tmp_path):
    """Lines without characters or tokens, alone and between others, are as in SQL."""
    import duckdb

    from paperloom.plans.catalog import QUERIES, SQL

    texts = ["a b\n\nct N.DC} Opcr.ting", "", None, "\n", "   \n\t\n x", " \n|||||||||"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("d1_symbol_garbage", "d2_token_garbage", "d8_validator"):
        rows = QUERIES[name](spark, str(tmp_path))
        want = con.execute(SQL[name])
        places = [[d[0] for d in want.description].index(c) for c in rows.columns]
        assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(repr(tuple(r[i] for i in places)) for r in want.fetchall())
