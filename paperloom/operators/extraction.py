"""From papers to their accepted and rejected questions, and the report of a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import intake, quality, segmentation
from paperloom.sources.checkpoints import cut


def numbered(leaf_rows: DataFrame) -> DataFrame:
    """Validated leaves with `ordinal`, the place among all of their paper, and `accepted_ordinal`, how many up to there weren't rejected."""
    order = Window.partitionBy("paper_id").orderBy("line_no", "main_ord", "sub_ord", "subsub_ord")
    accepted = F.count_if(F.col("status") != "rejected").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return leaf_rows.withColumns({"ordinal": F.row_number().over(order), "accepted_ordinal": accepted.cast("int")})


def row_id() -> Column:
    """Kind, paper, running number and the first digits of the text's MD5. A rejected question counts all of its paper before it, an accepted one only the accepted."""
    off = F.col("status") == "rejected"
    number = F.when(off, F.col("ordinal")).otherwise(F.col("accepted_ordinal"))
    return F.concat_ws("_", F.when(off, "rj").otherwise("rq"), F.col("paper_id").cast("string"), number.cast("string"), F.substring(F.md5("text"), 1, 8))


def paper_questions(papers: DataFrame) -> DataFrame:
    """C, D, E: the validated leaves of papers (paper_id, text), numbered: question_number, section, text, marks, confidence, status, reason, ordinals."""
    node_rows, _ = segmentation.parsed(papers)
    return numbered(quality.validate(segmentation.leaves(node_rows)))


def session_questions(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected questions of papers (session_id, paper_id, text) with original_id and their ids.

    Of papers of a session with the same content the first one is parsed; what is found in it, rejects included, is then joined to all of them. A copy's
    questions have the copy's paper in their ids and keep their numbers, so a paper that repeats a question has an id for each. A null text is an
    empty one; papers without questions have no rows.
    """
    content = F.coalesce("text", F.lit(""))
    hashed = papers.select("session_id", "paper_id", content.alias("text"), intake.content_hash(F.encode(content, "UTF-8")).alias("content_hash"))
    found = cut(intake.duplicate_papers(hashed).select("session_id", "paper_id", "original_id", "is_duplicate", "text"))
    once = paper_questions(found.filter("not is_duplicate").select("paper_id", "text"))
    copies = cut(intake.copied_to_duplicates(once, found.select("session_id", "paper_id", "original_id")).withColumn("id", row_id()))
    return quality.split(copies)


def reports(pages: DataFrame) -> DataFrame:
    """One row for each paper of `pages` (paper_id, page_no, text, image_count, ocr_text): page_count, method, question_count, sections_found, questions (nested), warnings, text.

    Papers without questions, sections or any text have their row too, with zeros and empty lists. Warnings are those of the parser in order of the lines, that of missing numbers,
    and those of too few questions. Lines are read, matched and sent once; only papers are written.
    """
    whole = cut(intake.assembled(intake.routed(pages)).select("paper_id", "full_text", "method", "page_count"))
    report = whole.join(segmentation.outlined(whole.select("paper_id", F.col("full_text").alias("text"))), "paper_id", "left")
    report = report.withColumns({"questions": F.coalesce("questions", F.array()), "warnings": F.coalesce("warnings", F.array().cast("array<string>"))}).withColumn("n", F.size("questions").cast("long"))
    return report.select(
        "paper_id", F.col("page_count").alias("page_count"), "method", F.col("n").alias("question_count"), F.coalesce("sections", F.lit(0)).alias("sections_found"),
        "questions", F.concat("warnings", segmentation.few_questions(F.col("page_count"), F.col("n"))).alias("warnings"), F.col("full_text").alias("text"),
    )
