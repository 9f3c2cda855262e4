import random
import re
from collections import Counter

from paperloom.llm.quality_rules import COUNTS, DecisionList, Threshold, judge, labelled_rows, learn_list, text_stats
from paperloom.llm.queries import QUERIES
from tests.llm.conftest import ODD


def counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_stats_and_base(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_quality_rules"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in COUNTS[:5]) == counts(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_random_repeats(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", "\n\n x "]) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: tuple(r[c] for c in COUNTS[:5]) for r in text_stats(docs).collect()} == {i: counts(t) for i, t in enumerate(texts)}


def test_verdict_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = judge(docs, train).join(held, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.95 * len(good)
    assert sum(bad) <= 0.25 * len(bad)


def test_list_is_what_its_expression_says(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = labelled_rows(text_stats(docs), labels)
    found = learn_list(rows)
    assert found.rules
    names = list(rows[0][0])
    got = spark.createDataFrame([tuple(r[n] for n in names) for r, _ in rows], names)
    sql = DecisionList(found.rules)
    direct = [sql.keeps(r) for r, _ in rows]
    rejected = [any(all((r[t.feature] >= t.at) == t.above or r[t.feature] == t.at for t in rule) for rule in found.rules) for r, _ in rows]
    assert direct == [not x for x in rejected] and got.count() == len(direct)


def test_learning_needs_both_classes():
    row = {"a": 1.0}
    assert learn_list([]).rules == learn_list([(row, True)] * 9).rules == learn_list([(row, False)] * 9).rules == []
    rows = [({"a": float(i), "b": float(i % 7)}, i >= 60) for i in range(100)]
    found = learn_list(rows)
    assert sum(found.keeps(r) != bad for r, bad in rows) >= 95
    assert Threshold("a", True, 2.0).holds({"a": 2.0})


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = sorted(repr((r.doc_id, *[r[c] for c in COUNTS[:5]])) for r in judge(odd, labels).collect())
    assert got == sorted(repr((k, *counts(t))) for k, t, *_ in ODD)
    assert judge(none, labels).count() == 0
    assert judge(odd, labels.filter("false")).filter("kept").count() == sum(not (c[0] < 10 or 100 * c[4] > 20 * c[0]) for c in (counts(t) for _, t, *_ in ODD))


def test_samples_where_keys_repeat(spark):
    """Of many rows of one key a sample by hash is taken, whatever their sizes; the key may have any name."""
    texts = [(1, " ".join(f"w{k}" for k in range(n))) for n in range(10, 90)]
    docs = spark.createDataFrame(texts, "_key long, text string")
    labels = spark.createDataFrame([(1, 1)], "_key long, quality int")
    stats = text_stats(docs, "_key")
    taken = sorted(r["n_words"] for r, _ in labelled_rows(stats, labels, "_key", most=20))
    assert len(taken) == 40 and min(taken) < 30 and max(taken) > 70
    assert len(labelled_rows(stats, labels, "_key")) == 80
    assert judge(docs, labels, key="_key").count() == 80
