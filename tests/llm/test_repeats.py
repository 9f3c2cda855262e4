import hashlib
import random

import numpy as np
import pytest

from paperloom.llm import repeats
from paperloom.llm.queries import QUERIES
from paperloom.llm.repeats import merged_spans, pieces, remove_repeats, removal_digests, segments
from tests.llm.conftest import ODD


def slow(docs, window=100):
    """By a table of all windows."""
    first = {}
    rows = [(k if k is not None else -(1 << 63), (t or "").encode()) for k, t in docs]
    for k, t in rows:
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            first[w] = min(first.get(w, (k, i)), (k, i))
    out = []
    for (key, _), (k, t) in zip(docs, rows):
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if first[t[i : i + window]] != (k, i):
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


def documents(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(8))
    line, passage = "".join(word() for _ in range(13)), "".join(word() for _ in range(40))
    texts = []
    for i in range(n):
        parts = ["".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), line)
        if rng.random() < 0.4:
            a = rng.randint(0, 100)
            parts.insert(0, passage[a : a + rng.randint(80, 300)])
        if texts and rng.random() < 0.3:
            old = list(rng.choice(texts))
            for _ in range(rng.randint(0, 3)):
                if old:
                    old[rng.randrange(len(old))] = "#"
            parts = ["".join(old)]
        if rng.random() < 0.1:
            parts.append("xy" * rng.randint(20, 200))
        texts.append("".join(parts))
    return list(enumerate(texts))


def test_each_window_is_in_one_segment():
    texts = [t.encode() for _, t in documents(1)]
    for most in (150, 1000, 10**6):
        seen = []
        for data, text, at, start, length in pieces(texts, 100, most):
            run, first, count, g, sh = segments(data, start, length)
            for r, f, c in zip(run, first, count):
                seen += [(int(text[r]), int(f - start[r] + at[r]) + j) for j in range(c)]
                assert c <= 69
        assert sorted(seen) == [(i, j) for i, t in enumerate(texts) for j in range(len(t) - 99)]


def test_equal_segments_have_equal_hashes():
    t = "".join(random.Random(3).choice("abc def") for _ in range(400)).encode()
    data, _, _, start, length = next(pieces([t, b"z" * 150, t]))
    run, first, count, g, sh = segments(data, start, length)
    one, two = ([(f - start[k], c, a, b) for r, f, c, a, b in zip(run, first, count, g, sh) if r == k] for k in (0, 2))
    assert one == two


def test_merged_spans():
    owner, start, end = merged_spans(np.array([1, 0, 1, 1, 0]), np.array([5, 0, 0, 20, 10]), np.array([10, 5, 5, 30, 12]))
    assert list(zip(owner.tolist(), start.tolist(), end.tolist())) == [(0, 0, 5), (0, 10, 12), (1, 0, 10), (1, 20, 30)]


@pytest.mark.parametrize("held,crowd", [(600_000, 40_000), (50, 40_000), (50, 3)])
def test_against_all_windows(spark, monkeypatch, held, crowd):
    """With few segments held and small crowds, all paths are taken."""
    docs = documents(held + crowd)
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "HELD", held)
    monkeypatch.setattr(repeats, "WINDOWS_AT_ONCE", 10 * held)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(removal_digests(df)) == slow(docs)


def test_odd_rows(spark, odd, none):
    assert got(removal_digests(odd)) == slow([(k, t) for k, t, *_ in ODD])
    rows = [(None, "a" * 50 + "b" * 120), (None, "b" * 110), (4, "b" * 130), (4, "c" * 100 + "b" * 130), (4, "b" * 130), (2, "q" * 99), (1, "q" * 99)]
    assert got(removal_digests(spark.createDataFrame(rows, "doc_id long, text string"))) == slow(rows)
    assert removal_digests(none).count() == 0


def test_kept_bytes(spark, sf):
    docs = spark.createDataFrame([(1, "a" * 30 + "x1y2z3" * 20), (2, "é" + "x1y2z3" * 20 + "tail")], "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert bytes(rows[2].kept) == "étail".encode()


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op7_repeated_passages"](spark, sf)) == slow(docs)
