"""Exam tables over the star schema, and text tables over documents and pages: the inputs of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Chapters of every session: the nouns that part names end in.
CHAPTERS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
CURRENT_YEAR = 2001


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table in fewer files than there are cores, dealt out to all cores; a larger table stays as its files are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() <= 4 * cores and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, paper_id, held (the year of the order), year (null where nobody knows it: every 17th paper), filename"""
    held = F.year("o_orderdate")
    name = F.concat(F.lit("Exam "), held.cast("string"), F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    year = F.when(F.col("o_orderkey") % 17 != 0, held)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("paper_id"), held.alias("held"), year.alias("year"), name.alias("filename"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, chapters, total_marks: a number, 0 or null"""
    total = F.when(F.col("session_id") % 3 == 0, 70).when(F.col("session_id") % 3 == 1, 0)
    return papers(spark, sf_dir).select("session_id").distinct().select("session_id", F.array(*[F.lit(c) for c in CHAPTERS]).alias("chapters"), total.alias("total_marks"))


def paper_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, ordinal, text, marks (null for a quantity of 13)"""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    # lines go to their papers at once, so they needn't be dealt out before
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("ordinal", F.row_number().over(order))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    verb = F.when(F.col("l_returnflag") == "A", "Explain").when(F.col("l_returnflag") == "N", "Describe").otherwise("Compare")
    text = F.concat(verb, F.lit(" the "), "p_name", F.when(F.col("l_linestatus") == "F", ".").otherwise(""))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("paper_id"), "ordinal", text.alias("text"), F.nullif("l_quantity", F.lit(13.0)).alias("marks"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, paper_id, year, filename, ordinal, text, marks"""
    return papers(spark, sf_dir).drop("held").join(paper_questions(spark, sf_dir), "paper_id")


def _with_marks() -> Column:
    given = F.concat(F.lit(" ("), F.col("marks").cast("int").cast("string"), F.lit(" marks)"))
    return F.concat("text", F.coalesce(given, F.lit("")))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, text: a page of each paper. Papers of even number have sections, those of number 3n ask in parts."""
    q = paper_questions(spark, sf_dir)
    number = F.when(F.col("paper_id") % 3 == 0, F.floor((F.col("ordinal") + 1) / 2)).otherwise(F.col("ordinal"))
    tail = _with_marks()
    flat = F.concat(F.lit("Q"), number.cast("string"), F.lit(". "), tail)
    part = F.when(F.col("ordinal") % 2 == 1, F.concat(F.lit("Q"), number.cast("string"), F.lit(". Answer the following:\n(a) "), tail)).otherwise(F.concat(F.lit("(b) "), tail))
    line = F.when(F.col("paper_id") % 3 == 0, part).otherwise(flat)
    line = F.when((F.col("paper_id") % 2 == 0) & (F.col("ordinal") == 1), F.concat(F.lit("SECTION A\n"), line)).otherwise(line)
    line = F.when((F.col("paper_id") % 2 == 0) & (F.col("ordinal") == 3), F.concat(F.lit("Page 2 of 3\nSECTION B\nLong Answer Questions\n"), line)).otherwise(line)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return q.groupBy("paper_id").agg(F.array_join(lines, "\n").alias("text"))


#: Labels that the kinds of papers of `rendered_deep` give to seven questions in a row: two levels, romans beside letters, i, v and x as letters, repeats, jumps.
LABELS = (
    ("a", "i", "ii", "b", "i", "iii", "c"),
    ("h", "i", "j", "k", "l", "m", "n"),
    ("1", "2", "2", "4", "5", "5", "9"),
    ("I", "1", "2", "II", "1", "5", "III"),
    ("u", "v", "w", "x", "1", "v", "y"),
)


def rendered_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, text: a page of each paper, seven parts to a main question, labelled by LABELS[paper_id % 5]."""
    q = paper_questions(spark, sf_dir)
    place = (F.col("ordinal") - 1) % 7
    kinds = F.array(*[F.array(*[F.lit(x) for x in labels]) for labels in LABELS])
    label = F.get(F.get(kinds, F.col("paper_id") % len(LABELS)), place)
    main = F.when(place == 0, F.concat(F.lit("Q"), (F.floor((F.col("ordinal") - 1) / 7) + 1).cast("string"), F.lit(". Consider this machine.\n"))).otherwise("")
    line = F.concat(main, F.lit("("), label, F.lit(") "), _with_marks())
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return q.groupBy("paper_id").agg(F.array_join(lines, "\n").alias("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, line"""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, paper_id, page_no, text, image_count, ocr_text.

    Four kinds of papers by turns: scans without embedded text, pages with their whole html as text, the two mixed, and pages whose embedded text is
    no more than title, heading and address. Scanned text is the whole html without its tags; a third of the latter papers' pages have none.
    """
    k = F.floor(F.col("page_id") / 5) % 4
    heads = F.concat_ws(" ", F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "url")
    text = F.when((k == 0) | ((k == 2) & (F.col("page_id") % 2 == 0)), F.lit("")).when(k == 3, heads).otherwise(F.col("html"))
    ocr = F.when((k == 3) & (F.col("page_id") % 3 == 0), F.lit("")).otherwise(F.regexp_replace("html", "<[^>]*>", " "))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.floor(F.col("page_id") / 5).alias("paper_id"), (F.col("page_id") % 5 + 1).cast("int").alias("page_no"), text.alias("text"), (F.col("page_id") % 2).cast("int").alias("image_count"), ocr.alias("ocr_text")
    )
