import hashlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import slow_fingerprint


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_one_by_one(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((name, before, docs.collect()))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    _, before, after = seen[0]
    good = {r.doc_id for r in before if r.doc_id in labels and labels[r.doc_id].quality and not labels[r.doc_id].toxic}
    assert len(good & {r.doc_id for r in after}) >= 0.9 * len(good)  # a few dozen labels here
    assert len(after) < len(before)

    _, before, after = seen[1]
    largest = {}
    for r in before:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        largest[text] = max(largest.get(text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(largest.values())

    _, before, after = seen[2]
    sets = {r.doc_id: shingles(r.text) for r in before}
    kept = {r.doc_id for r in after}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for gone in set(sets) - kept:
        assert any(near(gone, b) for b in sets if b != gone)
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and near(a, b)]
    assert pairs and not any(a in kept and b in kept for a, b in pairs)

    _, before, after = seen[3]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}

    _, before, after = seen[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in before)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in after) == want


def test_fingerprints_of_nothing():
    assert slow_fingerprint(None) == 0


def test_odd_rows(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 1, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", none)):
        sf = f"{tmp_path}/{name}"
        docs.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        # no copies, no texts without words; of equal texts the row with the largest key stays
        assert {r.doc_id for r in got} <= {2, 5, None, 7, 8, 9}
        assert bool(got) == (name == "odd")
        assert all(n <= 2 for n in Counter(r.doc_id for r in got).values())
