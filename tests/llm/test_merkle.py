import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm.merkle import Queue, backward, folded, forward, leaf_digest, manifest
from paperloom.llm.queries import QUERIES, SQL
from paperloom.llm.ranks import ranked
from tests.llm.conftest import ODD
from tests.llm.sql import same_as_sql


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """All levels, and the steps from each leaf to the root."""
    levels, steps = [nodes], [[] for _ in nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for i, own in enumerate(steps):
            p = i >> (len(levels) - 1)
            own.append("=" if p ^ 1 >= len(now) else ("<" if p & 1 else ">") + now[p ^ 1])
        levels.append([h(*now[k : k + 2]) for k in range(0, len(now), 2)])
    return levels[-1][0], steps


def expected(rows):
    """(key, leaf, subroot, root, proof) of rows (key, lang, leaf)."""
    langs = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = [], []
    for lang in langs:
        own = sorted([r for r in rows if r[1] == lang], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        subroot, steps = tree([r[2] for r in own])
        subroots.append(subroot)
        found.append([(r[0], r[2], subroot, s) for r, s in zip(own, steps)])
    root, above = tree(subroots)
    return [(k, x, subroot, root, s + up) for group, up in zip(found, above) for k, x, subroot, s in group]


def test_queue_spills_in_order():
    rng, queue, want = random.Random(2), Queue(held=7), []
    for _ in range(500):
        if rng.random() < 0.6 or not queue:
            message = (rng.randrange(1000), rng.random())
            queue.push(message)
            want.append(message)
        else:
            assert queue.least() == min(want)
            want.remove(got := queue.pop())
            assert got <= min(want, default=got)
    assert [queue.pop() for _ in range(len(want))] == sorted(want) and not queue


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 100])
def test_sweeps(n):
    nodes = [h(str(i)) for i in range(n)]
    root, log = forward(nodes, (n - 1).bit_length(), held=4)
    assert (root, backward(n, log, [], held=4)) == tree(nodes)


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_odd_rows(odd, none, levels):
    want = expected([(k, lang, leaf(k, source, lang, n, text)) for k, text, lang, source, n in ODD])
    rows = manifest(odd, levels=levels).withColumn("folded", folded(F.col("leaf"), F.col("proof"))).collect()
    assert sorted(map(repr, [(r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in rows])) == sorted(map(repr, want))
    assert {r.folded for r in rows} == {r.root for r in rows} and len({r.root for r in rows}) == 1
    assert manifest(none, levels=levels).count() == 0


def test_many_groups_and_one_row(spark):
    rows = [(i, f"g{i % 70}", str(i)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = manifest(docs, columns=("doc_id", "text"), levels=2).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got) == sorted(expected([(k, g, leaf(k, t)) for k, g, t in rows]))
    (one,) = manifest(docs.limit(1), columns=("doc_id", "text")).collect()
    assert one.leaf == one.subroot == one.root and one.proof == []


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(None if i % 9 == 0 else i % 3, rng.randrange(20)) for i in range(300)]
    df = spark.createDataFrame(rows, "part int, at int").repartition(5)
    got = [tuple(r) for r in ranked(df, ["part"], ["at"], "place", "size").collect()]
    want = []
    for g in {r[0] for r in rows}:
        own = sorted(r[1] for r in rows if r[0] == g)
        want += [(g, x, i, len(own)) for i, x in enumerate(own)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_leaf_of_odd_values(spark):
    df = spark.createDataFrame([("ü", None, 2**63 - 1)], "a string, b string, c long")
    assert df.select(leaf_digest([F.col("a"), F.col("b"), F.col("c")])).first()[0] == leaf("ü", None, 2**63 - 1)


def test_query(spark, sf):
    rows = QUERIES["op12_merkle_manifest"](spark, sf)
    same_as_sql(rows, SQL["op12_merkle_manifest"], sf)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {k: (x, subroot, root, h(*[s[1:] for s in proof])) for k, x, subroot, root, proof in expected([(d.doc_id, d.lang, leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text)) for d in docs.values()])}
    got = rows.collect()
    assert {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256) for r in got} == want
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or docs[r.doc_id].n_chars is None) for r in got)
