import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from paperloom.llm.alignment import Csr, align
from paperloom.llm.bpe import byte_letters
from paperloom.llm.queries import QUERIES
from tests.llm.conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = ["  two  spaces ", "a▁b is lost", "<s> <|endoftext|> <0x41> <unk>", "\n\n x\t y  ", "日本語 ünï 🙂🙂 é", "　 　", " ", "x \n y", "tail ", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30, "a b \x1c \x85c", "\0", "don't  we'll"]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, byte_letters(), {i: x for x, i in a.get_vocab().items()}


def plain(libraries, text):
    """Groups of a text as lists of ids of both, token by token; None where it has no tokens."""
    a, b, letters, names = libraries
    if not text:
        return None
    whole = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spans_a = [bytes(letters[c] for c in names[i]) for i in ids_a]
    spans_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    if b"".join(spans_a) != whole or b"".join(spans_b) != whole:
        return None
    cuts = set(np.cumsum([len(x) for x in spans_a]).tolist()) & set(np.cumsum([len(x) for x in spans_b]).tolist())
    overlaps, ranges = 0, []
    for spans in (spans_a, spans_b):
        ends = np.cumsum([len(x) for x in spans]).tolist()
        ranges.append(list(zip([0, *ends[:-1]], ends)))
    groups = [([i for i, (s, e) in zip(ids_a, ranges[0]) if lo <= s < hi], [i for i, (s, e) in zip(ids_b, ranges[1]) if lo <= s < hi]) for lo, hi in zip([0, *sorted(cuts)], sorted(cuts))]
    at = 0
    for s, e in ranges[0]:  # both lists ascend
        while at < len(ranges[1]) and ranges[1][at][1] <= s:
            at += 1
        k = at
        while k < len(ranges[1]) and ranges[1][k][0] < e:
            overlaps, k = overlaps + 1, k + 1
    return groups, overlaps


def expected(libraries, rows):
    found = [(k, plain(libraries, t)) for k, t in rows]
    links = [Counter((x, y) for xs, ys in got[0] for x in xs for y in ys) if got else Counter() for _, got in found]
    count = Counter(pair for own in links for pair in own)
    highest: dict = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for (k, got), own in zip(found, links):
        groups, overlaps = got or ([], 0)
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        best = sum(n for pair, n in own.items() if count[pair] == highest[pair[0]])
        out.append((k, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), overlaps, sum(own.values()), best, sum(n * count[p] for p, n in own.items()), text))
    return out


def test_products():
    rng = np.random.default_rng(1)
    for most in (1, 7, 1000):
        x, y = rng.random((9, 12)) < 0.3, rng.random((12, 8)) < 0.3
        a, b = (Csr(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m.shape[1]) for m in (x, y))
        got = np.zeros((9, 8), int)
        for rows, cols, values in a.times(b, most):
            got[rows, cols] += values
        assert (got == x.astype(int) @ y.astype(int)).all()
        back = b.transposed()
        assert [back.cols[i:j].tolist() for i, j in zip(back.starts, back.starts[1:])] == [np.flatnonzero(c).tolist() for c in y.T]


@pytest.mark.parametrize("most", [1, 10**9])
def test_odd_rows(spark, odd, none, libraries, most):
    rows = [(r[0], r[1]) for r in ODD] + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = odd.unionByName(spark.createDataFrame(rows[len(ODD) :], "doc_id long, text string"), allowMissingColumns=True).repartition(4)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_overlaps, r.n_links, r.n_best, r.count_sum, r.groups) for r in align(docs, A, B, most=most).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(libraries, rows)))
    assert align(none, A, B).count() == 0


def test_cut_texts_give_the_libraries_tokens(spark, libraries):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["word", "Wörter", " ", " ", "  ", "\n", "'s", ".", "12", "▁" if rng.random() < 0.02 else "x", "🙂", " ", "日"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_overlaps, r.n_links, r.n_best, r.count_sum, r.groups) for r in align(docs, A, B, most=500).collect()]
    assert sorted(got) == expected(libraries, rows)


def test_query(spark, sf, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_tokenizer_alignment"](spark, sf).collect()
    want = sorted((*w[:8], hashlib.sha256(w[8].encode()).hexdigest() if w[8] else "") for w in expected(libraries, docs))
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_overlaps, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
