"""Intake of papers: manifest, contexts, page routing, years and duplicate papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manifest(files: DataFrame) -> DataFrame:
    """A1: files with `accepted`: the name ends in .pdf in any case."""
    return files.withColumn("accepted", F.coalesce(F.lower("filename").endswith(".pdf"), F.lit(False)))


def first_by_name(files: DataFrame, *order: str) -> DataFrame:
    """A2: of equal names in a session the first."""
    by = Window.partitionBy("session_id", "filename").orderBy(*order)
    return files.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def contexts(forms: DataFrame) -> DataFrame:
    """A3: chapters (trimmed, once each, in order) and years (a map) from JSON texts; malformed ones are empty."""
    listed = F.coalesce(F.from_json("chapters_json", "array<string>"), F.array().cast("array<string>"))
    years = F.coalesce(F.from_json("years_json", "map<string,int>"), F.create_map().cast("map<string,int>"))
    trimmed = F.filter(F.transform(listed, lambda c: F.trim(c)), lambda c: c != "")
    return forms.withColumns({"chapters": F.array_distinct(trimmed), "years": years})


def content_hash(content: Column) -> Column:
    """A4"""
    return F.sha2(content, 256)


def routed(pages: DataFrame, short: int = 100, short_with_images: int = 250) -> DataFrame:
    """A5: chosen_text and origin. Scanned text is wanted where embedded text is short; a blank scan falls back to the embedded text."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    wanted = (n < short) | ((F.col("image_count") > 0) & (n < short_with_images))
    scanned = wanted & (F.trim(F.coalesce("ocr_text", F.lit(""))) != "")
    return pages.withColumns({"chosen_text": F.when(scanned, F.col("ocr_text")).otherwise(F.coalesce("text", F.lit(""))), "origin": F.when(scanned, "ocr").otherwise("text")})


def assembled(pages: DataFrame) -> DataFrame:
    """One row a paper from routed pages: full_text, method, page_count."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("page_no", "chosen_text"))), lambda p: p["chosen_text"])
    scans = F.count_if(F.col("origin") == "ocr")
    method = F.when(scans == F.count(F.lit(1)), "ocr").when(scans == 0, "text").otherwise("hybrid")
    return pages.groupBy("paper_id").agg(F.array_join(texts, "\n\n").alias("full_text"), method.alias("method"), F.count(F.lit(1)).alias("page_count"))


YEAR = r"\b(20[0-3]\d|199\d)\b"


def filename_year(filename: Column) -> Column:
    """the first year in a file name."""
    return F.nullif(F.regexp_extract(filename, YEAR, 1), F.lit("")).cast("int")


def page_year(text: Column, low: int = 2010, high: int = 2032) -> Column:
    """the first year on a page within the range."""
    years = F.transform(F.regexp_extract_all(text, F.lit(YEAR), 1), lambda y: y.cast("int"))
    return F.get(F.filter(years, lambda y: y.between(low, high)), F.lit(0))


def resolved_year(rows: DataFrame) -> DataFrame:
    """year and year_source from override, stored, from_name and from_page, in that order."""
    sources = (("override", "override"), ("stored", "stored"), ("from_name", "filename"), ("from_page", "page"))
    source = None
    for column, name in sources:
        source = F.when(F.col(column).isNotNull(), name) if source is None else source.when(F.col(column).isNotNull(), name)
    return rows.withColumns({"year": F.coalesce(*[c for c, _ in sources]), "year_source": source.otherwise("manual")})


def paper_status(rows: DataFrame) -> DataFrame:
    """papers without a year need one; their session fails, its other papers go on."""
    missing = F.col("year").isNull()
    session = Window.partitionBy("session_id")
    return rows.withColumns({"status": F.when(missing, "needs_year").otherwise("ready"), "session_status": F.when(F.max(missing.cast("int")).over(session) == 1, "failed").otherwise("ready")})


def overridden(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """years of an override table (session_id, filename, year) put before those that rows have; an override without a paper is passed over."""
    new = overrides.groupBy("session_id", "filename").agg(F.max("year").alias("_new"))
    return rows.join(new, ["session_id", "filename"], "left").withColumn("year", F.coalesce("_new", "year")).drop("_new")


def duplicate_papers(rows: DataFrame) -> DataFrame:
    """G1: original_id, the first paper of the session with the same content, and whether a row is a duplicate."""
    same = rows.groupBy("session_id", "content_hash").agg(F.min("paper_id").alias("original_id"))
    return rows.join(same, ["session_id", "content_hash"]).withColumn("is_duplicate", F.col("paper_id") != F.col("original_id"))


def copied_to_duplicates(results: DataFrame, originals: DataFrame) -> DataFrame:
    """G1: what was found in originals (results by paper_id), for every paper with the same content."""
    found = results.withColumnRenamed("paper_id", "original_id")
    return originals.select("session_id", "paper_id", "original_id").join(found, "original_id")
