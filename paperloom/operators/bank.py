"""The question bank: exact groups, topics, priority scores, rollups and bank queries (G2-G5, I, J, K, L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import normal_text, text_hash
from paperloom.sources.checkpoints import cut

LEVELS = ("critical", "very_high", "high", "medium", "low")
# Chapters of a session without any, and keyword packs by the word that a chapter's name contains.
DEFAULT_CHAPTERS = ("Process Management", "CPU Scheduling", "Deadlocks", "Memory Management", "File Systems & Storage", "General & Intro")
PACKS = {
    "scheduling": ("quantum", "priority", "round robin", "fcfs", "sjf", "srtf", "scheduler"),
    "deadlock": ("avoidance", "banker", "prevention", "semaphore", "safe state", "resource allocation"),
    "memory": ("paging", "segmentation", "thrashing", "virtual memory", "page fault", "replacement", "fragmentation"),
    "process": ("thread", "semaphore", "mutex", "critical section", "synchronization", "ipc", "concurrency"),
    "file": ("inode", "directory", "disk", "raid", "allocation", "sector", "access control"),
}


def to_tenth(x: Column) -> Column:
    """Rounded to one decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def hashed(questions: DataFrame) -> DataFrame:
    return questions.withColumn("content_hash", text_hash(normal_text(F.col("text"))))


#: Papers of a session up to which its questions are dealt out to one task as they are; those of larger sessions combine before they are sent.
DEALT = 20_000


def coded_wordings(words: DataFrame) -> DataFrame:
    """A row for each text of `words` and for the null text: text, content_hash, and numbers w of the text and g of the content_hash, both in the order of content_hash. Of few texts, as one task orders them."""
    none = words.sparkSession.range(1).select(F.lit(None).cast("string").alias("text"))
    numbers = Window.orderBy("content_hash", "text")
    return hashed(words.select("text").union(none)).withColumn("w", F.row_number().over(numbers)).withColumn("g", F.min("w").over(Window.partitionBy("content_hash")))


def coded(questions: DataFrame, codes: DataFrame) -> DataFrame:
    """Questions with w and g of their texts in place of text, where all texts are among the codes, so that wordings travel as numbers."""
    known = F.broadcast(codes.select(F.col("text").alias("_text"), "w", "g"))
    return questions.join(known, F.col("text").eqNullSafe(F.col("_text"))).drop("text", "_text")


def few_papers(papers: DataFrame) -> bool:
    """Whether no session has more than DEALT papers."""
    return (papers.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0) <= DEALT


def dealt_by_session(questions: DataFrame, codes: DataFrame) -> DataFrame:
    """Coded questions, dealt out by session once and given back text and content_hash there. Whatever groups or windows follow within sessions take no other shuffle."""
    return questions.repartition("session_id").join(F.broadcast(codes.drop("g")), "w").drop("w", "g")


def exact_groups(questions: DataFrame) -> DataFrame:
    """One row for each session and content_hash, with the longest wording (the earliest of those as long) and statistics.

    Marks and years that are null are passed over. All aggregates combine in each task first, so a wording that a third of all
    papers ask costs a row a task; years are a set of a few dozen at most, so that one shuffle does, where counting them apart takes two.
    """
    groups = questions.groupBy("session_id", "content_hash").agg(
        F.max_by("text", F.struct(F.length("text"), -F.col("paper_id"), -F.col("ordinal"))).alias("canonical_text"),
        F.count(F.lit(1)).alias("occurrences"),
        F.avg("marks").alias("avg_marks"),
        F.max("marks").alias("max_marks"),
        F.sum("marks").alias("sum_marks"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.size(F.collect_set("year")).cast("long").alias("n_years"),
        F.min(F.struct("paper_id", "ordinal")).alias("place"),
    )
    return groups.withColumn("year_span", F.coalesce(F.col("last_year") - F.col("first_year"), F.lit(0)))


def exact_groups_of_years(questions: DataFrame) -> DataFrame:
    """G2-G4 without wordings and marks: occurrences and years of each session_id and content_hash."""
    groups = questions.groupBy("session_id", "content_hash").agg(F.count(F.lit(1)).alias("occurrences"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.size(F.collect_set("year")).cast("long").alias("n_years"))
    return groups.withColumn("year_span", F.coalesce(F.col("last_year") - F.col("first_year"), F.lit(0)))


def year_counts(questions: DataFrame) -> DataFrame:
    """session_id, content_hash, year and n: how many questions of a group are of each year, null among them. What the years of a group follow from."""
    return questions.groupBy("session_id", "content_hash", "year").agg(F.count(F.lit(1)).alias("n"))


def year_changes(questions: DataFrame, changes: DataFrame) -> DataFrame:
    """what papers with another year (paper_id, year) take from the counts of years and add to them, from the questions of those papers alone."""
    new = changes.groupBy("paper_id").agg(F.max("year").alias("_new"))
    moved = questions.join(new, "paper_id").filter(~F.col("year").eqNullSafe(F.col("_new")))
    steps = F.explode(F.array(F.struct(F.col("year").alias("year"), F.lit(-1).alias("n")), F.struct(F.col("_new").alias("year"), F.lit(1).alias("n"))))
    return moved.select("session_id", "content_hash", steps.alias("x")).groupBy("session_id", "content_hash", F.col("x.year").alias("year")).agg(F.sum("x.n").alias("n"))


def changed_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """the counts of years of the groups that changes touch, as they are now."""
    touched = changes.select("session_id", "content_hash").distinct()
    both = counts.join(touched, ["session_id", "content_hash"], "left_semi").unionByName(changes)
    return both.groupBy("session_id", "content_hash", "year").agg(F.sum("n").alias("n")).filter("n > 0")


def restated_years(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """groups with first_year, last_year, n_years and year_span after their counts where they are given, all else as it was. No other group is computed again."""
    years = counts.groupBy("session_id", "content_hash").agg(F.min("year").alias("_first"), F.max("year").alias("_last"), F.count("year").alias("_n"))
    found = groups.join(years, ["session_id", "content_hash"], "left")
    own = F.col("_n").isNotNull()
    new = {"first_year": F.col("_first"), "last_year": F.col("_last"), "n_years": F.col("_n"), "year_span": F.coalesce(F.col("_last") - F.col("_first"), F.lit(0))}
    return found.withColumns({c: F.when(own, x).otherwise(F.col(c)) for c, x in new.items()}).drop("_first", "_last", "_n")


def occurrences(questions: DataFrame, groups: DataFrame) -> DataFrame:
    """One row a question with its group."""
    return questions.join(groups.select("session_id", "content_hash"), ["session_id", "content_hash"]).select("session_id", "content_hash", "paper_id", "ordinal", "year", "marks")


def topics(contexts: DataFrame) -> DataFrame:
    """session_id, topic_idx, topic from chapters; defaults where there are none."""
    names = F.when(F.size("chapters") > 0, F.col("chapters")).otherwise(F.array(*[F.lit(c) for c in DEFAULT_CHAPTERS]))
    return contexts.select("session_id", F.posexplode(names).alias("topic_idx", "topic"))


def topic_keywords(name: Column) -> Column:
    """Words of three letters or more in the name, and the packs of words that it contains; repeated keywords stay."""
    low = F.lower(name)
    own = F.regexp_extract_all(low, F.lit(r"(?U)\b(\w{3,})\b"), 1)
    packs = [F.when(low.contains(word), F.array(*[F.lit(k) for k in pack])).otherwise(F.array().cast("array<string>")) for word, pack in PACKS.items()]
    return F.concat(own, *packs)


def classified(groups: DataFrame, topic_rows: DataFrame) -> DataFrame:
    """Groups with topic and topic_idx. Most keywords found in the wording win, earlier topics first; without any, the
    first topic whose whole name is found; else the last.

    A session's topics travel as one array, so each group is scored in place and groups aren't multiplied.
    """
    return _with_topic(groups.join(_topic_lists(topic_rows), "session_id"))


def _topic_lists(topic_rows: DataFrame) -> DataFrame:
    """session_id and its topics with their keywords, in order, as one array."""
    entry = F.struct("topic_idx", "topic", topic_keywords(F.col("topic")).alias("keywords"))
    return topic_rows.groupBy("session_id").agg(F.sort_array(F.collect_list(entry)).alias("_topics"))


#: Pairs of a list of topics and a wording up to which each pair is looked at once, whatever groups have it.
JUDGED = 50_000


def judged_topics(topic_rows: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """For sessions that share lists of topics: session_id and topic_list, a number; and the topic of each topic_list and wording (text) as canonical_text. None beyond JUDGED pairs."""
    per = _topic_lists(topic_rows)
    lists = cut(per.select("_topics").distinct().withColumn("topic_list", F.monotonically_increasing_id()))
    if lists.count() * words.count() > JUDGED:
        return None
    pairs = lists.crossJoin(words.select(F.col("text").alias("canonical_text")))
    return per.join(F.broadcast(lists), "_topics").select("session_id", "topic_list"), cut(_with_topic(pairs).select("topic_list", "canonical_text", "topic"))


def _with_topic(joined: DataFrame) -> DataFrame:
    """I3-I5 for rows with canonical_text and the topics of their session."""
    low = F.lower("canonical_text")
    # the greatest of (matches, earlier first)
    scored = F.transform("_topics", lambda t: F.struct(F.size(F.filter(t["keywords"], lambda k: low.contains(k))).alias("n"), (-t["topic_idx"]).alias("early"), t["topic"].alias("topic")))
    best = F.array_max(scored)
    named = F.get(F.filter("_topics", lambda t: low.contains(F.lower(t["topic"]))), F.lit(0))["topic"]
    last = F.element_at("_topics", -1)["topic"]
    joined = joined.withColumn("_best", best)
    topic = F.when(F.col("_best")["n"] > 0, F.col("_best")["topic"]).otherwise(F.coalesce(named, last))
    return joined.withColumn("topic", topic).drop("_topics", "_best")


def denominators(papers: DataFrame, groups: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Of each session of papers the distinct known years, papers, most occurrences of a group, and marks: total_marks of the context if above 0, else the most of any
    group. Papers and sessions without questions count as well."""
    base = paper_counts(papers)
    most = groups.groupBy("session_id").agg(F.max("occurrences").alias("s_occurrences"), F.max("max_marks").alias("s_marks"))
    rows = base.join(most, "session_id", "left")
    if contexts is not None:
        rows = rows.join(_given_marks(contexts), "session_id", "left").withColumn("s_marks", F.coalesce("_total", "s_marks")).drop("_total")
    return rows.select("session_id", *_positive())


def paper_counts(papers: DataFrame) -> DataFrame:
    """Distinct known years and papers of each session."""
    return papers.groupBy("session_id").agg(F.count_distinct("year").alias("s_years"), F.count(F.lit(1)).alias("s_papers"))


def _given_marks(contexts: DataFrame) -> DataFrame:
    return contexts.select("session_id", F.when(F.col("total_marks") > 0, F.col("total_marks")).alias("_total"))


def _positive() -> list[Column]:
    """J1's columns, each with what stands for none or zero."""
    positive = lambda c, d: F.when(F.col(c) > 0, F.col(c)).otherwise(d)
    return [positive(c, F.lit(d)).alias(c) for c, d in (("s_years", 1), ("s_papers", 1), ("s_occurrences", 1), ("s_marks", 10.0))]


def with_denominators(groups: DataFrame, papers: DataFrame, contexts: DataFrame, *more: DataFrame) -> DataFrame:
    """Groups with their session's denominators, and with the columns that `more` has of sessions. Groups are dealt out by session once; what follows from a session's groups is a window over them."""
    session = Window.partitionBy("session_id")
    rows = groups.repartition("session_id").join(paper_counts(papers), "session_id").join(_given_marks(contexts), "session_id", "left")
    for of in more:
        rows = rows.join(of, "session_id")
    rows = rows.withColumns({"s_occurrences": F.max("occurrences").over(session), "s_marks": F.coalesce("_total", F.max("max_marks").over(session))})
    return rows.select(*groups.columns, *_positive(), *[c for of in more for c in of.columns if c != "session_id"])


def in_clusters(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Groups (with idx) with cluster_id, cluster_size and confidence of the clusters of similar wordings."""
    size = F.count(F.lit(1)).over(Window.partitionBy("session_id", "seed"))
    of = clusters.select("session_id", "idx", F.concat_ws("_", F.lit("c"), F.col("session_id").cast("string"), F.col("seed").cast("string")).alias("cluster_id"), "confidence", size.cast("int").alias("cluster_size"))
    return groups.join(of, ["session_id", "idx"])


# The weights of the factors, the limits of the levels and the wording of the reasons.


def factors(rows: DataFrame, current_year: int) -> DataFrame:
    """Six factors of groups that have J1's and J2's columns (cluster_size among them)."""
    recency = F.when(F.col("last_year").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - 20.0 * (current_year - F.col("last_year"))))
    weight = F.when(F.coalesce("avg_marks", F.lit(0.0)) == 0, 50.0).otherwise(F.least(F.lit(100.0), 100.0 * F.col("avg_marks") / F.col("s_marks")))
    return rows.withColumns({
        "f_freq": 100.0 * F.col("occurrences") / F.col("s_occurrences"),
        "f_recency": recency,
        "f_marks": weight,
        "f_spread": 100.0 * F.col("n_years") / F.col("s_years"),
        "f_cluster": F.least(F.lit(100.0), 25.0 * (F.col("cluster_size") - 1)),
        "f_chapter": F.lit(50.0),
    })


def score() -> Column:
    """J9"""
    weights = (("f_freq", 0.30), ("f_recency", 0.25), ("f_marks", 0.20), ("f_spread", 0.15), ("f_cluster", 0.07), ("f_chapter", 0.03))
    total = F.lit(0.0)
    for name, w in weights:
        total = total + F.col(name) * w
    return to_tenth(total)


def level(points: Column) -> Column:
    """J10"""
    return F.when(points >= 85, "critical").when(points >= 70, "very_high").when(points >= 50, "high").when(points >= 30, "medium").otherwise("low")


def explanation() -> Column:
    """A sentence from up to five reasons."""
    pick = lambda c, *steps: F.when(F.col(c) >= steps[0][0], steps[0][1]) if len(steps) == 1 else F.when(F.col(c) >= steps[0][0], steps[0][1]).when(F.col(c) >= steps[1][0], steps[1][1])
    year = F.concat(F.lit("was asked recently (last in "), F.col("last_year").cast("string"), F.lit(")"))
    reasons = F.array_compact(F.array(
        pick("f_freq", (80, F.lit("is extremely frequent across papers")), (50, F.lit("has appeared multiple times"))),
        pick("f_recency", (80, year), (50, F.lit("was asked in recent years"))),
        pick("f_spread", (60, F.lit("shows high consistency across multiple years"))),
        pick("avg_marks", (8, F.concat(F.lit("carries high weightage ("), F.col("avg_marks").cast("int").cast("string"), F.lit(" marks on average)")))),
        F.when(F.col("cluster_size") > 1, F.concat(F.lit("appears in "), F.col("cluster_size").cast("string"), F.lit(" similar variations"))),
    ))
    n = F.size(reasons)
    name = F.initcap(F.replace(F.col("priority_level"), F.lit("_"), F.lit(" ")))
    several = F.concat(F.array_join(F.slice(reasons, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(reasons, -1))
    because = F.when(n == 1, F.get(reasons, F.lit(0))).when(n > 1, several)
    none = F.concat(F.lit("Ranked "), name, F.lit(" based on standard frequency and spacing factors."))
    return F.when(n > 0, F.concat(F.lit("Ranked "), name, F.lit(" because it "), because, F.lit("."))).otherwise(none)


def scored(groups: DataFrame, sessions: DataFrame | None, current_year: int) -> DataFrame:
    """J2-J9 for groups with cluster_size and a session's denominators; None if groups have these already."""
    return factors(groups if sessions is None else groups.join(sessions, "session_id"), current_year).withColumn("priority_score", score())


def explained(rows: DataFrame) -> DataFrame:
    """Scored groups with priority_level and priority_reason."""
    return rows.withColumn("priority_level", level(F.col("priority_score"))).withColumn("priority_reason", explanation())


def session_totals(papers: DataFrame, questions: DataFrame, groups: DataFrame) -> DataFrame:
    """K1-K3: papers, questions, distinct clusters (groups without one count alone) and repeat rate of each session of papers, those without questions included."""
    all_papers = papers.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_papers"))
    raw = questions.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_questions"))
    unique = groups.groupBy("session_id").agg(F.count_distinct(F.coalesce("cluster_id", "content_hash")).alias("unique_questions"))
    rows = all_papers.join(raw, "session_id", "left").join(unique, "session_id", "left").fillna(0, ["total_questions", "unique_questions"])
    rate = F.when(F.col("total_questions") > 0, to_tenth(100.0 * (1 - F.col("unique_questions") / F.col("total_questions")))).otherwise(0.0)
    return rows.withColumn("repeat_rate", rate)


def level_distribution(bank: DataFrame) -> DataFrame:
    """K4, K7: groups of each session and level, zeros included, with the level's share and the shares before it."""
    counts = bank.groupBy("session_id").agg(*[F.count_if(F.col("priority_level") == name).alias(name) for name in LEVELS], F.count(F.lit(1)).alias("total"))
    rows = counts.select("session_id", "total", F.posexplode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("n")) for n in LEVELS])).alias("place", "x"))
    share = F.col("n") / F.col("total")
    before = F.sum(share).over(Window.partitionBy("session_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("session_id", "total", "place", "x.level", "x.n").withColumns({"share": share, "share_before": F.coalesce(before, F.lit(0.0))}).drop("place", "total")


def topic_weightage(bank: DataFrame, topic_rows: DataFrame) -> DataFrame:
    """K5: occurrences and marks of every topic of a session, and their shares of the session's; null marks count as 0."""
    per = bank.groupBy("session_id", "topic").agg(F.sum("occurrences").alias("n"), F.sum(F.coalesce(F.col("sum_marks"), F.lit(0.0))).alias("m"))
    rows = topic_rows.join(per, ["session_id", "topic"], "left").fillna({"n": 0, "m": 0.0})
    whole = Window.partitionBy("session_id")
    share = lambda c: F.when(F.sum(c).over(whole) > 0, to_tenth(100.0 * F.col(c) / F.sum(c).over(whole))).otherwise(0.0)
    return rows.select("session_id", "topic_idx", "topic", F.col("n").alias("occurrences"), F.round("m").cast("long").alias("marks"), share("n").alias("occurrence_share"), share("m").alias("marks_share"))


def analytics(totals: DataFrame, levels: DataFrame, weightage: DataFrame, trend: DataFrame) -> DataFrame:
    """A10: one row a session of `totals` with all of its rollups: four totals, groups of each level, topics (most asked first, then in their order) and years in order.

    levels, weightage and trend are as K4, K5 (with topic_idx) and K6 give them. A session without questions has zeros for its levels, its topics and no years.
    """
    spread = levels.groupBy("session_id").agg(*[F.coalesce(F.sum(F.when(F.col("level") == name, F.col("n"))), F.lit(0)).alias(name) for name in LEVELS])
    distribution = F.struct(*[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in LEVELS]).alias("priority_distribution")
    topic_id = F.concat_ws("_", F.lit("t"), F.col("session_id").cast("string"), F.col("topic_idx").cast("string"))
    area = F.struct((-F.col("occurrences")).alias("rank"), "topic_idx", topic_id.alias("topic_id"), F.col("topic").alias("name"), F.col("occurrences").alias("count"), F.col("occurrence_share").alias("freq_pct"), F.col("marks_share").alias("marks_pct"))
    areas = weightage.groupBy("session_id").agg(F.sort_array(F.collect_list(area)).alias("areas"))
    fields = ("topic_id", "name", "count", "freq_pct", "marks_pct")
    years = trend.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("year", F.col("occurrences").alias("count")))).alias("years"))
    rows = totals.join(spread, "session_id", "left").join(areas, "session_id", "left").join(years, "session_id", "left")
    return rows.select(
        "session_id", "total_papers", F.col("total_questions").alias("total_raw_questions"), F.col("unique_questions").alias("total_unique_questions"), "repeat_rate", distribution,
        F.coalesce(F.transform("areas", lambda a: F.struct(*[a[f].alias(f) for f in fields])), F.array()).alias("focus_areas"),
        F.coalesce("years", F.array()).alias("year_trends"),
    )


def year_trend(questions: DataFrame) -> DataFrame:
    """K6"""
    return questions.filter("year is not null").groupBy("session_id", "year").agg(F.count(F.lit(1)).alias("occurrences"))


def ranked(bank: DataFrame) -> DataFrame:
    """L1: by score, ties by session and hash."""
    return bank.orderBy(F.desc("priority_score"), "session_id", "content_hash")


def filtered(bank: DataFrame, level: str | None = None, topic: str | None = None, min_marks: float | None = None, repeated: bool = False, like: str | None = None, search: str | None = None) -> DataFrame:
    """Conjunction of the filters given. like: a pattern with % and _ around which anything may stand; search: literal, in wording or topic; both in any case."""
    if level is not None:
        bank = bank.filter(F.col("priority_level") == level)
    if topic is not None:
        bank = bank.filter(F.col("topic") == topic)
    if min_marks is not None:
        bank = bank.filter(F.col("max_marks") >= min_marks)
    if repeated:
        bank = bank.filter(F.col("occurrences") > 1)
    if like is not None:
        bank = bank.filter(F.col("canonical_text").ilike(f"%{like}%"))
    if search is not None:
        low = search.lower()
        bank = bank.filter(F.lower("canonical_text").contains(low) | F.lower(F.coalesce("topic", F.lit(""))).contains(low))
    return bank


def timeline(bank: DataFrame, occurrence_rows: DataFrame, paper_rows: DataFrame) -> DataFrame:
    """For each group the occurrences of its cluster, by year; one row an occurrence.

    Groups meet occurrences on their cluster's id, so no group is asked for by itself. Occurrences that have their paper's filename with them bring it along;
    others meet the papers before they are multiplied.
    """
    clusters = bank.select("session_id", "content_hash", F.coalesce("cluster_id", "content_hash").alias("cluster"))
    if "filename" not in occurrence_rows.columns:
        occurrence_rows = occurrence_rows.join(paper_rows.select("paper_id", "filename"), "paper_id")
    inside = occurrence_rows.join(clusters, ["session_id", "content_hash"]).select("session_id", "cluster", "filename", "ordinal", "year", "marks")
    return clusters.join(inside, ["session_id", "cluster"]).select("session_id", "content_hash", "filename", "ordinal", "year", "marks")


def session_status(paper_rows: DataFrame) -> DataFrame:
    """Failed if any paper needs a year, else complete, with the papers in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("paper_id", "filename", "status"))), lambda p: F.concat_ws(":", p["filename"], p["status"]))
    bad = F.count_if(F.col("status") != "ready")
    return paper_rows.groupBy("session_id").agg(F.when(bad > 0, "failed").otherwise("complete").alias("status"), F.count(F.lit(1)).alias("papers"), F.array_join(listed, ", ").alias("listing"))


def gated(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """Rows of complete sessions only."""
    return rows.join(statuses.filter(F.col("status") == "complete").select("session_id"), "session_id", "left_semi")


def year_label() -> Column:
    """Null where no year is known."""
    return F.when(F.col("first_year").isNull(), F.lit(None).cast("string")).when(F.col("first_year") == F.col("last_year"), F.col("first_year").cast("string")).otherwise(F.concat_ws("–", F.col("first_year").cast("string"), F.col("last_year").cast("string")))
