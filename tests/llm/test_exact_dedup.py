import hashlib
from collections import defaultdict

import numpy as np

from paperloom.llm.exact_dedup import _low, _owner_of, drop_copies, exact_groups, golomb_decode, golomb_encode
from paperloom.llm.queries import QUERIES, SQL
from tests.llm.conftest import ODD
from tests.llm.sql import same_as_sql

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def test_golomb_round_trip():
    rng = np.random.default_rng(3)
    for owners in (1, 3, 7):
        values = np.unique(rng.integers(0, 2**48, 5000).astype(np.uint64))
        owner = _owner_of(values, owners)
        assert owner.max() < owners
        for o in range(owners):
            own = values[owner == o]
            assert (own >= _low(o, owners)).all()
            k, unary, rest = golomb_encode(own, _low(o, owners))
            assert (golomb_decode(len(own), k, unary, rest, _low(o, owners)) == own).all()
            assert len(unary) + len(rest) < 8 * len(own)


def test_odd_rows(odd, none):
    groups = defaultdict(list)
    for key, text, *_ in ODD:
        groups[(text or "").encode().translate(LOWER)].append(key)
    got = exact_groups(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[bytes(r.sha)].append(r)
    for text, keys in groups.items():
        rows = by[hashlib.sha256(text).digest()]
        best = max((k for k in keys if k is not None), default=None)
        assert [r.group_size for r in rows] == [len(keys)] * len(keys)
        assert [r.keep_id for r in rows] == [best] * len(keys)
        assert [r.doc_id for r in rows if r.kept] == [best]
    kept = drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (r.doc_id for r in got if r.kept)))
    assert exact_groups(none).count() == 0 == drop_copies(none).count()


def test_query(spark, sf):
    same_as_sql(QUERIES["op6_exact_dedup"](spark, sf), SQL["op6_exact_dedup"], sf)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "A", 5, "x", 1), (2, "a", 6, "y", 2), (3, "b", 7, "z", 3), (3, "b", 7, "z", 3)], "doc_id long, text string, own_sha int, GONE_key string, _gone_sha int")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "a", 6, "y", 2), (3, "b", 7, "z", 3)]
