import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm.mixing import mix, mixed_documents
from paperloom.llm.queries import QUERIES
from tests.llm.conftest import ODD


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def verify(rows, docs, slack):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        sizes[source] += words(text)
    target = shared(sizes)
    by = defaultdict(list)
    for key, text, source in docs:
        by[key].append((words(text), source))
    assert len(rows) == len(docs)
    for r in rows:
        assert r.taken <= 2 * r.size
        source = next(s for n, s in by[r.doc_id] if n == r.size)
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(target[source])
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack(s)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op5_mix_sources"](spark, sf).collect()
    verify(rows, docs, lambda s: 1)
    assert sorted(rows) == sorted(QUERIES["op5_mix_sources"](spark, sf).collect())


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "source").collect()
    most = defaultdict(int)
    for r in rows:
        most[r.source] = max(most[r.source], words(r.text))
    got = mix(docs, whole_documents=True).collect()
    verify(got, [tuple(r) for r in rows], lambda s: most[s])
    assert all(r.size == 0 or r.taken % r.size == 0 for r in got)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = defaultdict(int)
    for r in mixed.collect():
        times[r.doc_id] += 1
    assert times == {r.doc_id: r.taken // r.size for r in got if r.size and r.taken}


def test_lighter_documents_come_later(spark):
    rows = [(i, "a " * 10 if i % 2 else "a## " * 10, s) for i in range(2000) for s in "xy"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs, weights=(3, 1), share=0.9).collect()
    part = [r for r in got if r.target < r.source_size]
    clean, dirty = (sum(r.taken for r in part if r.doc_id % 2 == k) for k in (1, 0))
    assert clean > 1.5 * dirty > 0


def test_odd_rows(odd, none):
    got = mix(odd).collect()
    verify(got, [(k, t, s) for k, t, _, s, _ in ODD], lambda s: 1)
    assert mixed_documents(odd).columns == odd.columns
    assert mix(none).count() == 0 == mixed_documents(none).count()


def test_picks_by_a_plain_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mark = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", "source", mark.alias("mark"), F.xxhash64(F.lit(17), mark).alias("h")).collect()
    got = {r.doc_id: r for r in mix(docs).collect()}
    by = defaultdict(list)
    for r in rows:
        size = words(r.text)
        quality = 1 / (1 + 5 * len(re.findall(r"[#*$%&|<>!]", r.text or "")) / max(1, size))
        u = ((r.h % 2**64 >> 12) + 0.5) / 2**52
        by[r.source].append((-math.log(u) / quality, r.doc_id, size))
    for listed in by.values():
        whole = sum(size for _, _, size in listed)
        target = got[listed[0][1]].target
        epochs = int(target // whole)
        left = math.floor(target + 0.5) - epochs * whole
        for _, key, size in sorted(listed):
            more = max(0, min(size, left))
            left -= size
            assert got[key].taken == epochs * size + more


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1, 2), (2, "d e", "x", 3, 4), (3, "f", "y", 5, 6)], "doc_id long, text string, source string, own_mark int, _MIX_times int")
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()}
