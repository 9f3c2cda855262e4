"""Years that change, files of a folder, and the scorer with corpus statistics, against plain loops."""

import hashlib
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.operators import bank, similarity
from paperloom.sources import files
from paperloom.sources.files import new_folder, paper_files, write_texts


def test_years_by_retraction_are_those_of_a_rebuild(spark):
    rng = random.Random(4)
    rows = [(s, 10 * s + p, rng.choice((2001, 2002, 2003, None)), f"Explain the {rng.choice('abcd')}") for s in range(4) for p in range(6) for _ in range(3)]
    years = {p: y for _, p, y, _ in rows}
    rows = [(s, p, years[p], t, 5.0, i) for i, (s, p, _, t) in enumerate(rows)]
    schema = "session_id long, paper_id long, year int, text string, marks double, ordinal int"
    qs = bank.hashed(spark.createDataFrame(rows, schema))
    # to another year, to the same one, to none, from none, and a paper without questions
    changes = [(1, 1999), (2, years[2]), (11, None), *[(p, 2010) for p, y in years.items() if y is None][:2], (999, 2000)]
    new = dict(changes)
    after = bank.hashed(spark.createDataFrame([(s, p, new.get(p, y), *rest) for s, p, y, *rest in rows], schema))
    given = spark.createDataFrame(changes, "paper_id long, year int")
    moved = bank.year_changes(qs, given)
    names = ["session_id", "content_hash", "occurrences", "first_year", "last_year", "n_years", "year_span", "canonical_text"]
    got = bank.restated_years(bank.exact_groups(qs), bank.changed_counts(bank.year_counts(qs), moved)).select(names).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, bank.exact_groups(after).select(names).collect()))
    assert not bank.year_changes(qs, given.filter("paper_id = 2")).count()


def test_files_of_a_folder(spark):
    path = new_folder(spark, "files").removeprefix("file:")
    folder = Path(path)
    folder.mkdir(parents=True)
    given = {"a+b 100%.pdf": b"\x00\xffbytes", "B.PDF": b"\n", "c.pdf.exe": b"x", "no suffix": b"y", "sub/d.Pdf": b"z"}
    (folder / "sub").mkdir()
    for name, content in given.items():
        (folder / name).write_bytes(content)
    (folder / "empty.pdf").touch()
    got = {(r.filename, r.length, r.accepted, r.content_hash) for r in paper_files(spark, f"file:{path}").collect()}
    want = set()
    for name, content in given.items():
        name, ok = name.rsplit("/")[-1], name.lower().endswith(".pdf")
        want.add((name, len(content), ok, hashlib.sha256(content).hexdigest() if ok else None))
    assert got == want
    # as a writer of Spark's names them
    spark.createDataFrame([("100%=a.pdf", "x")], "name string, text string").write.partitionBy("name").text(f"{path}-written")
    (one,) = paper_files(spark, f"{path}-written").collect()
    assert (one.filename, one.length, one.content_hash) == ("100%=a.pdf", 2, hashlib.sha256(b"x\n").hexdigest())


@pytest.mark.parametrize("threshold", [0.9, 0.5, 0.1])
def test_tfidf_by_a_plain_loop(spark, threshold):
    rng = random.Random(9)
    texts = sorted({" ".join(rng.choice("the a gear bolt rod Rod plate of and explain".split()) for _ in range(rng.randint(1, 6))) for _ in range(60)} | {""})
    sessions = {1: texts, 2: texts[:7], 3: ["alone"]}
    groups = spark.createDataFrame([(s, i, t) for s, ts in sessions.items() for i, t in enumerate(ts)], "session_id long, idx int, canonical_text string")
    want = {}
    for s, ts in sessions.items():
        bags = [t.lower().split() for t in ts]
        weight = {w: math.log((1 + len(ts)) / (1 + sum(w in b for b in bags))) + 1 for b in bags for w in b}
        vectors = [{w: b.count(w) * weight[w] for w in b} for b in bags]
        lengths = [math.sqrt(sum(x * x for x in v.values())) or 1.0 for v in vectors]
        for j in range(len(ts)):
            for i in range(j):
                score = sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items()) / lengths[i] / lengths[j]
                if score >= threshold:
                    want[s, i, j] = score
    got = {(r.session_id, r.i, r.j): r.score for r in similarity.tfidf_pairs(groups, threshold).collect()}
    assert got == pytest.approx(want)
    assert similarity.tfidf_pairs(groups.filter(F.lit(False)), threshold).count() == 0


@pytest.mark.parametrize("small", [256, 5])
def test_tfidf_deals_groups_out_once(spark, monkeypatch, small):
    """Sessions up to SMALL meet where they were dealt to, so no vector or pair is shuffled; larger ones give the same pairs."""
    monkeypatch.setattr(similarity, "SMALL", small)
    texts = ["the red bolt", "the red bolt the", "red bolt", "a gear", "the gear a", "gear", "bolt gear"]
    groups = spark.createDataFrame([(s, i, t) for s in (1, 2) for i, t in enumerate(texts[: 7 if s == 1 else 4])], "session_id long, idx int, canonical_text string")
    found = similarity.tfidf_pairs(groups, 0.7)
    if small == 256:
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the same one for both sides
    got = sorted((r.session_id, r.i, r.j, round(r.score, 9)) for r in found.collect())
    monkeypatch.setattr(similarity, "SMALL", 256)
    assert got and got == sorted((r.session_id, r.i, r.j, round(r.score, 9)) for r in similarity.tfidf_pairs(groups, 0.7).collect())


def test_paper_files_are_read_in_one_pass(spark, tmp_path):
    """One scan of the folder: nothing is joined or shuffled, rejects have no hash."""
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    found = paper_files(spark, str(tmp_path))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Exchange" not in text
    assert sorted((r.filename, r.accepted, r.content_hash is None) for r in found.collect()) == [("a.pdf", True, False), ("b.txt", False, True)]


@pytest.mark.parametrize("most", [1000, 3])
def test_texts_are_one_file_each(spark, monkeypatch, most):
    """A paper takes one file, not a folder and a checksum as well; equal names are files of their own, and what an attempt left aside isn't read."""
    monkeypatch.setattr(files, "FOLDER_FILES", most)
    path = new_folder(spark, "texts")
    given = [(f"Doc {i % 40}.pdf", f"é {i % 40}\n") for i in range(50)] + [("a%2B =1.PDF", ""), ("x.docx", "no")]
    write_texts(spark.createDataFrame(given, "name string, text string").repartition(3), path)
    root = Path(path.removeprefix("file:"))
    (root / "_0-left").mkdir()
    (root / "_0-left" / "Doc 1.pdf").write_text("half")
    below = [x for x in root.rglob("*") if "_0-left" not in str(x)]
    assert sum(x.is_file() for x in below) == len(given)
    assert most == 3 or sum(x.is_dir() for x in below) <= 9
    want = [(name, len(text.encode()) + 1, name.lower().endswith(".pdf"), hashlib.sha256(f"{text}\n".encode()).hexdigest() if name != "x.docx" else None) for name, text in given]
    assert sorted(map(repr, ((r.filename, r.length, r.accepted, r.content_hash) for r in paper_files(spark, path).collect()))) == sorted(map(repr, want))
    # a store that only Spark opens has the same rows of names that differ
    monkeypatch.setattr(files, "_local", lambda spark, folder: None)
    assert sorted(r.content_hash or "" for r in paper_files(spark, path).collect()) == sorted(x[3] or "" for x in want)
    other = new_folder(spark, "texts")
    write_texts(spark.createDataFrame(given[:40], "name string, text string"), other)
    assert sorted(map(repr, ((r.filename, r.length, r.accepted, r.content_hash) for r in paper_files(spark, other).collect()))) == sorted(map(repr, want[:40]))


@pytest.mark.parametrize("table", [2048, 0])
def test_years_with_wordings_as_numbers(spark, tmp_path, monkeypatch, table):
    """F5 on tables with names that differ in case and blanks, by numbers of wordings and without: rows as in SQL, and numbers leave no text to shuffle."""
    import duckdb

    from paperloom.operators import similarity as H
    from paperloom.plans import catalog

    monkeypatch.setattr(H, "TABLE", table)
    orders = [(o, o % 3 + 1, f"199{o % 5}-02-03") for o in range(1, 60)]
    lines = [(o, n, (o * n) % 6, 1, 10.0, "1995-01-01", float(o * n % 20), "ANR"[o * n % 3], "FO"[n % 2]) for o, *_ in orders for n in range(1, 5)]
    parts = [(k, n) for k, n in enumerate(["red bolt", "Red bolt", "gear", "a gear.", "red  bolt", "rod"])]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem", "part"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    rows = catalog.QUERIES["f5_incremental_years"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, con.execute(catalog.SQL["f5_incremental_years"]).fetchall()))
    found = catalog._coded(spark, str(tmp_path))
    assert (found is None) == (table == 0)
    if found:
        assert {"text", "content_hash"}.isdisjoint(found[0].columns)


def test_wordings_come_back_from_their_numbers(spark):
    """Questions dealt out by session are those that were coded, the null text among them, and their groups take that one shuffle."""
    texts = ["Explain it.", "explain it", None, "Describe it", ""]
    qs = spark.createDataFrame([(s, 10 * s + i, i, t, 5.0, 2000 + i) for s in (1, 2) for i, t in enumerate(texts)], "session_id long, paper_id long, ordinal int, text string, marks double, year int")
    codes = bank.coded_wordings(similarity.wordings(qs))
    back, whole = bank.dealt_by_session(bank.coded(qs, codes), codes), bank.hashed(qs)
    names = whole.columns
    assert sorted(map(repr, back.select(names).collect())) == sorted(map(repr, whole.collect()))
    groups = bank.exact_groups(back)
    assert groups._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(session_id") == 1
    assert sorted(map(repr, groups.select("session_id", "content_hash", "canonical_text", "occurrences", "n_years").collect())) == sorted(map(repr, bank.exact_groups(whole).select("session_id", "content_hash", "canonical_text", "occurrences", "n_years").collect()))
    assert bank.few_papers(qs.select("session_id"))


@pytest.mark.parametrize("table", [2048, 0])
def test_export_is_in_order(spark, sf, monkeypatch, table):
    """The files one after the other are the rows of SQL in its order, by numbers of wordings and without; levels and reasons aren't sorted along."""
    import csv

    import duckdb

    from paperloom.operators import similarity as H
    from paperloom.plans import catalog

    monkeypatch.setattr(H, "TABLE", table)
    put, written = files.export_csv, []

    def export(bank, path, late, codes):
        assert (codes is None) == (table == 0) and {"priority_level", "priority_reason"}.isdisjoint(bank.columns)
        written.append(path)
        put(bank, path, late, codes)

    monkeypatch.setattr(files, "export_csv", export)
    catalog.QUERIES["a8_csv_export"](spark, sf)
    got = []
    for part in sorted(Path(written[0].removeprefix("file:")).glob("part-*.csv")):
        with open(part, newline="") as lines:
            got += [(r["Question Wording"], r["Priority Level"], float(r["Priority Score (0-100)"]), float(r["Average Marks"] or "nan"), int(r["Occurrence Count"]), r["Topic/Chapter"], r["Priority Analysis Reason"]) for r in csv.DictReader(lines)]
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(f"{catalog.SQL['a8_csv_export']} ORDER BY priority_score DESC, session_id, content_hash").fetchall()
    plain = lambda r: repr(tuple("nan" if x is None or x != x else round(x, 9) if isinstance(x, float) else x for x in r))
    assert list(map(plain, got)) == list(map(plain, want))


def test_cut_leaves_no_shuffle(spark, tmp_path):
    """Shuffle files of what is cut go when it is written, and the session's setting is as it was."""
    from paperloom.sources import checkpoints

    before = spark.conf.get(checkpoints.CLEANUP, None)
    kept = lambda: {x for top in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for x in Path(str(top)).rglob("shuffle_*.data")}
    there = kept()
    rows = checkpoints.cut(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    assert rows.agg(F.sum("count")).first()[0] == 1000
    assert not {x for x in kept() - there if x.stat().st_size > 1000}
    assert spark.conf.get(checkpoints.CLEANUP, None) == before


def test_timeline_meets_in_sessions(spark, sf, monkeypatch):
    """With numbers for wordings, groups and occurrences are dealt out by session alone; rows are those of the way for many wordings."""
    import re

    from paperloom.operators import similarity as H
    from paperloom.plans import catalog

    few = catalog.QUERIES["l8_cluster_timeline"](spark, sf)
    plan = few._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)}
    assert keys <= {"session_id", "paper_id", "l_orderkey", "content_hash", "w", "p_partkey", "l_partkey", "g, content_hash"}
    monkeypatch.setattr(H, "TABLE", 0)
    assert sorted(map(repr, map(tuple, few.collect()))) == sorted(map(repr, map(tuple, catalog.QUERIES["l8_cluster_timeline"](spark, sf).collect())))
