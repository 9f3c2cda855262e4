"""Scores by hand and greedy clusters against the plain loop; a two-year session from end to end."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import bank, similarity
from paperloom.plans import catalog
from paperloom.sources import checkpoints

SESSION = [
    (1, 2023, "Explain Round Robin CPU scheduling algorithm with an example", 10),
    (1, 2023, "Discuss the Banker's algorithm for deadlock avoidance", 10),
    (1, 2023, "What is paging? Describe page translation", 5),
    (2, 2024, "Describe Round Robin CPU scheduling with an example", 10),
    (2, 2024, "Explain the working of Banker's algorithm for deadlock avoidance", 10),
    (2, 2024, "What is page fault? Explain FIFO page replacement", 5),
]


def lcs(a, b):
    """Length of the longest common subsequence by the usual table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def token_set_score(x, y):
    """The token-set ratio of two texts, one pair at a time."""
    a, b = set(x.split()), set(y.split())
    if not a or not b:
        return 0.0
    both, only_a, only_b = a & b, a - b, b - a
    if both and (not only_a or not only_b):
        return 1.0
    s, p, q = (" ".join(sorted(t)) for t in (both, only_a, only_b))
    k = 1 if s else 0
    score = 1 - (len(p) + len(q) - 2 * lcs(p, q)) / (2 * (len(s) + k) + len(p) + len(q))
    if s:
        score = max(score, 1 - (k + len(p)) / (2 * len(s) + k + len(p)), 1 - (k + len(q)) / (2 * len(s) + k + len(q)))
    return score


def scores_of(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, x string, y string")
    return [r.s for r in df.select("i", similarity.token_set(F.col("x"), F.col("y")).alias("s")).orderBy("i").collect()]


def test_scores(spark):
    t = [x[2] for x in SESSION]
    got = scores_of(spark, [(t[0], t[3]), (t[1], t[4]), (t[2], t[5]), ("a b", "b a c"), ("", "a"), ("abc", "xyz"), (None, "a"), (None, None), ("é\U0001f600x", "é\U0001f600y")])
    assert got == pytest.approx([0.9032, 0.9184, 0.5412, 1.0, 0.0, 0.0, 0.0, 0.0, 2 / 3], abs=1e-4)


def test_scores_like_a_plain_loop(spark):
    rng = random.Random(8)
    pairs = [tuple(" ".join("".join(rng.choice("abcé.") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6))) for _ in range(2)) for _ in range(300)]
    assert scores_of(spark, pairs) == pytest.approx([token_set_score(x, y) for x, y in pairs], abs=1e-12)


@pytest.mark.parametrize("compared", [1, 5_000, 4_000_000])
def test_lcs(monkeypatch, compared):
    monkeypatch.setattr(similarity, "COMPARED", compared)
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("abc \U0001f600") for _ in range(rng.choice((0, 3, 63, 64, 65, 150)))) for _ in range(2)) for _ in range(300)]
    pairs += [("a" * 128, "a" * 200), ("ab" * 100, "ba" * 100)]
    assert similarity.lcs_lengths(*map(list, zip(*pairs))).tolist() == [lcs(a, b) for a, b in pairs]
    assert similarity.lcs_lengths([], []).tolist() == []


@pytest.mark.parametrize(("folded", "places"), [(10**6, 4096), (20, 6), (0, 5), (0, 4096)])
def test_clusters_are_those_of_the_loop(spark, monkeypatch, folded, places):
    monkeypatch.setattr(similarity, "FOLDED", folded)
    monkeypatch.setattr(similarity, "RANGE", places)
    rng = random.Random(11)
    edges, want = [], {}
    for s in range(30):
        n = rng.randint(2, 25)
        links = {(i, j): 0.84 + rng.random() / 10 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.15}
        edges += [(s, i, j, w) for (i, j), w in links.items()]
        free = list(range(n))
        while free:
            seed = free.pop(0)
            want[s, seed] = (seed, 1.0)
            for j in [j for j in free if (seed, j) in links]:
                want[s, j] = (seed, links[seed, j])
                free.remove(j)
    groups = spark.createDataFrame([(s, i, "x") for s, i in want], "session_id long, idx int, canonical_text string")
    got = similarity.greedy_clusters(groups, spark.createDataFrame(edges, "session_id long, i int, j int, score double"))
    assert {(r.session_id, r.idx): (r.seed, r.confidence) for r in got.collect()} == want


def test_a_long_chain_takes_few_jobs(spark):
    """Each group is linked to the next one, so every other one is a seed; how long the chain is makes no more jobs than it has ranges."""
    n = 40_000
    groups = spark.range(n).select(F.lit(1).cast("long").alias("session_id"), F.col("id").cast("int").alias("idx"), F.lit("x").alias("canonical_text"))
    edges = groups.filter(F.col("idx") < n - 1).select("session_id", F.col("idx").alias("i"), (F.col("idx") + 1).alias("j"), F.lit(0.9).alias("score"))
    found = similarity.greedy_clusters(groups, edges)
    assert found.filter("seed = idx - idx % 2").count() == n == found.count()


def test_two_year_session(spark):
    rows = [(7, p, y, t, float(m), i) for i, (p, y, t, m) in enumerate(SESSION)]
    qs = bank.hashed(spark.createDataFrame(rows, "session_id long, paper_id long, year int, text string, marks double, ordinal int"))
    groups = similarity.indexed(bank.exact_groups(qs))
    clusters = similarity.greedy_clusters(groups, similarity.similar_pairs(groups))
    sizes = similarity.representatives(groups, clusters)
    rows = groups.join(clusters, ["session_id", "idx"]).join(sizes, ["session_id", "seed"]).withColumn("cluster_id", F.col("seed").cast("string"))
    contexts = spark.createDataFrame([(7, ["CPU Scheduling", "Deadlocks", "Memory Management"], 70.0)], "session_id long, chapters array<string>, total_marks double")
    papers = qs.select("session_id", "paper_id", "year").distinct()
    sessions = bank.denominators(papers, groups, contexts)
    found = bank.scored(bank.classified(rows, bank.topics(contexts)), sessions, 2024).orderBy("idx").collect()
    assert [r.seed for r in found] == [0, 1, 2, 0, 1, 5]
    assert [r.topic for r in found] == ["CPU Scheduling", "Deadlocks", "Memory Management"] * 2
    assert [r.priority_score for r in found] == pytest.approx([63.6, 63.6, 60.4, 68.6, 68.6, 65.4], abs=0.11)
    assert {r.priority_level for r in found} == {"high"}
    totals = bank.session_totals(papers, qs, rows).first()
    assert (totals.total_papers, totals.total_questions, totals.unique_questions, totals.repeat_rate) == (2, 6, 4, 33.3)


def texts_of(rng, n):
    """Wordings that share tokens, and some that differ by letters only."""
    words = "alpha beta gamma delta gear gears bolt bolts of the explain".split()
    texts = {"", "a"}
    while len(texts) < n:
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            k = rng.randint(0, len(text))
            text = text[:k] + rng.choice(("", "x", "é", ".")) + text[k + rng.randint(0, 1) :]
        texts.add(text.strip())
    return sorted(texts)


@pytest.mark.parametrize(("small", "block"), [(256, 256), (0, 7), (20, 256)])
def test_pairs_by_a_plain_loop(spark, monkeypatch, small, block):
    monkeypatch.setattr(similarity, "SMALL", small)
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(5)
    texts = texts_of(rng, 120)
    sessions = {s: rng.sample(texts, rng.randint(1, 60)) for s in range(4)}
    groups = spark.createDataFrame([(s, i, t) for s, ts in sessions.items() for i, t in enumerate(ts)], "session_id long, idx int, canonical_text string")
    want = {(s, i, j): token_set_score(min(ts[i], ts[j]), max(ts[i], ts[j])) for s, ts in sessions.items() for i in range(len(ts)) for j in range(i + 1, len(ts))}
    for threshold, index in ((0.95, similarity.TOKEN_SET_INDEX), (0.84, similarity.TOKEN_SET_INDEX), (0.75, similarity.TOKEN_SET_INDEX), (0.5, similarity.TOKEN_SET_INDEX), (0.84, None)):
        got = {(r.session_id, r.i, r.j): r.score for r in similarity.similar_pairs(groups, threshold=threshold, index=index).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= threshold})


@pytest.mark.parametrize("threshold", [0.9, 0.6, 0.3])
def test_jaccard_pairs_by_a_plain_loop(spark, monkeypatch, threshold):
    monkeypatch.setattr(similarity, "SMALL", 0)
    texts = texts_of(random.Random(6), 70)
    groups = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session_id long, idx int, canonical_text string")
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
    got = similarity.similar_pairs(groups, similarity.token_jaccard, threshold, bound=None, index=similarity.JACCARD_INDEX)
    assert {(r.i, r.j) for r in got.collect()} == want


def test_index_leaves_most_pairs_out(spark):
    rng = random.Random(7)
    syllables = "ka lo mi ter vun sha dri po qua zel".split()
    names = ["".join(rng.choice(syllables) for _ in range(3)) for _ in range(300)]
    texts = sorted({f"{rng.choice(('Explain', 'Describe'))} the {rng.choice(names)} {rng.choice(names)} and its {rng.choice(names)}" for _ in range(400)})
    groups = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "session_id long, idx int, canonical_text string")
    assert len(texts) > similarity.SMALL
    words, placed = similarity._numbered(groups)
    n = similarity.candidate_pairs(placed, words, 0.84, similarity.TOKEN_SET_INDEX).count()
    assert n < len(texts) * (len(texts) - 1) / 2 / 4


def test_bound_is_no_less_than_the_score(spark):
    rng = random.Random(6)
    pairs = [tuple(" ".join("".join(rng.choice("abcé.") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 4))) for _ in range(2)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "x string, y string")
    rows = df.select("x", "y", similarity.token_set_bound(F.col("x"), F.col("y")).alias("bound")).collect()
    assert all(r.bound >= token_set_score(r.x, r.y) - 1e-9 for r in rows)


def test_odd_sessions(spark):
    papers = spark.createDataFrame([(1, 1, 2020), (1, 2, None), (2, 3, None)], "session_id long, paper_id long, year int")
    qs = bank.hashed(spark.createDataFrame([(1, 1, 2020, "Explain a gear", None, 0), (1, 1, 2020, "Explain a gear", 10.0, 1), (1, 1, 2020, "Explain a gear", None, 2)], "session_id long, paper_id long, year int, text string, marks double, ordinal int"))
    groups = bank.exact_groups(qs).withColumn("cluster_id", F.lit(None).cast("string"))
    totals = {r.session_id: r for r in bank.session_totals(papers, qs, groups).collect()}
    assert tuple(totals[1])[1:] == (2, 3, 1, 66.7) and tuple(totals[2])[1:] == (1, 0, 0, 0.0)
    contexts = spark.createDataFrame([(1, ["gear"], 0.0), (2, ["gear"], None)], "session_id long, chapters array<string>, total_marks double")
    assert {r.session_id: (r.s_years, r.s_marks) for r in bank.denominators(papers, groups, contexts).collect()} == {1: (1, 10.0), 2: (1, 10.0)}
    topics = bank.topics(contexts)
    weight = {r.session_id: (r.occurrences, r.marks) for r in bank.topic_weightage(bank.classified(groups, topics), topics).collect()}
    assert weight == {1: (3, 10), 2: (0, 0)}


@pytest.mark.parametrize("small", [256, 3])
def test_wordings_of_many_sessions_are_scored_once(spark, monkeypatch, small):
    """Sessions with the same few wordings: wordings meet once, and each session has the pairs that it had by itself."""
    monkeypatch.setattr(similarity, "SMALL", small)
    texts = ["explain the red bolt", "explain the red bolts", "bolt red the explain", "describe a cold ring", "describe the cold ring", "list all gears"]
    rows = [(s, k, texts[(k + s) % len(texts)]) for s in range(12) for k in range(3 + s % 4)]
    groups = spark.createDataFrame(rows, "session_id long, idx int, canonical_text string")
    seen, scored = [], similarity.scored_pairs
    monkeypatch.setattr(similarity, "scored_pairs", lambda pairs, *more: seen.append(pairs.count()) or scored(pairs, *more))
    got = sorted((r.session_id, r.i, r.j, round(r.score, 9)) for r in similarity.similar_pairs(groups).collect())
    want = []
    for s in range(12):
        mine = [(k, t) for x, k, t in rows if x == s]
        want += [(s, i, j, round(token_set_score(min(x, y), max(x, y)), 9)) for i, x in mine for j, y in mine if i < j and token_set_score(x, y) >= 0.84]
    assert got == sorted(want) and got
    assert seen[0] <= len(texts) * (len(texts) + 1) // 2


def test_cut_holds_repeated_values_once(spark):
    """What is written for a result that is read again grows by bits a row where wordings and hashes repeat."""
    rows = spark.range(50_000, numPartitions=1).select(F.sha2((F.col("id") % 7).cast("string"), 256).alias("content_hash"), F.concat(F.lit("Explain the bolt "), F.col("id") % 7).alias("text"))
    found = checkpoints.cut(rows)
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoints.shared_folder(spark))
    before = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    again = checkpoints.cut(rows)
    after = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    assert found.count() == again.count() == 50_000 and found.schema == rows.schema
    assert after - before < 50_000 * 10


def test_timeline_brings_filenames_along(spark):
    """Occurrences that have a filename aren't joined to the papers; others give the same rows."""
    qs = spark.createDataFrame([(1, "x", 7, 1, 2020, 5.0, "a.pdf"), (1, "y", 8, 2, None, None, "b.pdf"), (2, "x", 9, 1, 2021, 1.0, "c.pdf")], "session_id long, content_hash string, paper_id long, ordinal int, year int, marks double, filename string")
    groups = qs.select("session_id", "content_hash", F.when(F.col("session_id") == 1, "c1").alias("cluster_id")).distinct()
    papers = qs.select("paper_id", "filename")
    one, two = bank.timeline(groups, qs, papers), bank.timeline(groups, qs.drop("filename"), papers)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) and one.count() == 5
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert (joins(one), joins(two)) == (2, 3)


@pytest.mark.parametrize("together", [1, 25, 40_000])
def test_clusters_by_table_are_those_of_the_pairs(spark, monkeypatch, together):
    """Sessions of 1 to 70 groups, a null wording and a null session among them; batches end inside sessions."""
    monkeypatch.setattr(similarity, "TOGETHER", together)
    rng = random.Random(5)
    words = [" ".join(rng.sample(["alpha", "beta", "gamma", "delta", "epsilon"], 3)) for _ in range(90)] + [None]
    words = list(dict.fromkeys(words))
    rows = []
    for s in (3, 1, None, 2, 7, 8):
        for k, text in enumerate(rng.sample(words, min(len(words), rng.choice((1, 2, 9, 33, 60))))):
            rows.append((s, f"h{k}", text, (rng.randint(0, 3), k), k))
    groups = spark.createDataFrame(rows, "session_id long, content_hash string, canonical_text string, place struct<paper_id: long, ordinal: int>, n int")
    table = similarity.score_table(similarity.wordings(groups.withColumn("text", F.col("canonical_text"))))
    placed = similarity.indexed(groups)
    want = bank.in_clusters(placed, similarity.greedy_clusters(placed, similarity.similar_pairs(placed)))
    columns = ["session_id", "content_hash", "canonical_text", "n", "idx", "cluster_id", "cluster_size", "confidence"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(r) for r in similarity.clustered_by_table(groups, table).select(*columns).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {tuple(r) for r in want.select(*columns).collect()}
    assert len({r[5] for r in got}) < len(got) == sum(r[0] is not None for r in rows)


def test_no_table_of_many_wordings(spark, monkeypatch):
    words = similarity.wordings(spark.createDataFrame([("a b",), ("b a c",), (None,)], "text string"))
    assert similarity.score_table(words) == {"a b": {"b a c": 1.0}, "b a c": {"a b": 1.0}}
    monkeypatch.setattr(similarity, "TABLE", 1)
    assert similarity.score_table(words) is None


@pytest.mark.parametrize("name", ["j11_explanation", "l10_completeness_gate"])
def test_bank_by_tables_and_by_joins(spark, sf, monkeypatch, name):
    """few wordings need no pairs of groups and no groups written; the way for many wordings gives the same rows."""
    joins = catalog._clustered
    monkeypatch.setattr(catalog, "_clustered", None)
    got = sorted(map(repr, catalog.QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(catalog, "_clustered", joins)
    monkeypatch.setattr(similarity, "TABLE", 10)
    assert got == sorted(map(repr, catalog.QUERIES[name](spark, sf).collect()))
