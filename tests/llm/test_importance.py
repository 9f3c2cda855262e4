import math

import numpy as np

from paperloom.llm.importance import BUCKETS, Model, fitted, keep_good, kth_largest, ngrams, select
from paperloom.llm.queries import QUERIES
from tests.llm.conftest import ODD


def test_ngrams_stay_in_their_text():
    texts = [b"one two two", b"", b"one", b"two two x"]
    words, pairs, fours = ngrams(texts)
    assert words[0].tolist() == [0, 0, 0, 2, 3, 3, 3]
    assert words[1][0] == words[1][3] and words[1][1] == words[1][2] == words[1][4]
    assert pairs[0].tolist() == [0, 0, 3, 3]
    assert pairs[1][1] == pairs[1][2] == BUCKETS
    alone = [sum(np.bincount(b, minlength=3 * BUCKETS) for _, b in ngrams([t])) for t in texts if len(t) > 3]
    assert len(alone) == 2 and list(ngrams([])) == []
    assert np.unique(fours[0], return_counts=True)[1].tolist() == [9, 1, 7]  # each with the space after its text


def test_kth_largest(spark):
    values = np.random.default_rng(1).normal(size=5000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "draw double")
    for k in (1, 7, 2500, 5000):
        assert kth_largest(df, k, few=50) == sorted(values, reverse=True)[k - 1]


def test_agrees_with_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = select(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1 and toxic = 0"), "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.2 * len(bad)


def test_query(spark, sf):
    rows = QUERIES["op3_importance_quality"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    # the k largest draws stay
    k = round(sum(1 / (1 + math.exp(-r.log_weight)) for r in rows))
    assert sum(r.kept for r in rows) == k
    assert min(r.draw for r in rows if r.kept) >= max((r.draw for r in rows if not r.kept), default=-np.inf)
    assert sorted(rows) == sorted(QUERIES["op3_importance_quality"](spark, sf).collect())


def test_draws_decide_near_the_level(spark):
    sf = "/root/testdata/sf0.1"
    rows = select(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))).collect()
    assert any(r.kept for r in rows if r.log_weight < 0)
    assert not all(r.kept for r in rows if r.log_weight >= 0)
    # labels that it hasn't been fitted to alone: most toxic texts go, and good ones stay
    kept = {r.doc_id for r in rows if r.kept}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good, toxic = [r.doc_id in kept for r in labels if r.quality and not r.toxic], [r.doc_id in kept for r in labels if r.toxic]
    assert sum(good) >= 0.98 * len(good)
    assert sum(toxic) <= 0.45 * len(toxic)


def test_a_text_scores_alike_alone_and_beside_others():
    model = Model(np.random.default_rng(2).normal(size=3 * BUCKETS), 0.3, np.abs(np.random.default_rng(3).normal(size=BUCKETS)))
    texts = [b"one two two", b"", b"x", b"\xc3\xa9t\xc3\xa9 a\nb", b"abc", b"one  two "]
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts])
    # by a plain loop, over words and pairs of words and four bytes in a row with the space that follows
    words, pairs, fours = ({} for _ in range(3))
    for grams, found in zip(ngrams([b"one two two"]), (words, pairs, fours)):
        found.update(enumerate(grams[1].tolist()))
    assert (len(words), len(pairs), len(fours)) == (3, 2, 9)
    total = sum(model.ratios[b] for found in (words, pairs, fours) for b in found.values())
    want = (total + 20 * 0.3) / (14 + 20) - 1.5 / 60 * sum(model.marks[b] for b in words.values())
    assert math.isclose(together[0], want)


def test_model_by_a_plain_loop():
    raw, target, of_target, of_toxic = (np.zeros(3 * BUCKETS) for _ in range(4))
    raw[:4], target[:4], of_target[:4], of_toxic[:4] = [10, 20, 5, 1], [4, 0, 5, 1], [4, 0, 5, 1], [0, 9, 1, 2]
    model = fitted(raw, target, of_target, of_toxic, 10, 10)
    for b in range(6):
        want = math.log((target[b] + 0.5) / (10 + 0.5 * BUCKETS) / ((raw[b] + 1) / (36 + BUCKETS)))
        assert math.isclose(model.ratios[b], want)
    assert model.marks[:4].tolist() == [0, math.log((9.5 / 11) / (0.5 / 11)), 0, 0]


def test_stage_keeps_what_select_keeps(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in select(docs, labels).filter("kept").collect())


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 1, 0), (5, 0, 0), (8, 1, 1), (9, None, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("quality = 0"), labels.filter("false")):
        assert select(odd, some).count() == len(ODD)
        assert select(none, some).count() == 0 == keep_good(none, some).count()
        assert keep_good(odd, some).columns == odd.columns
    assert select(odd, labels.filter("false")).filter("kept").count() == len(ODD)
    assert Model(np.zeros(3 * BUCKETS)).scores([b"", b"a b"]).tolist() == [0, 0]
