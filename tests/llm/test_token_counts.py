import functools
import math
import random
from collections import Counter

import public_tokenizers
import regex
from tokenizers import Tokenizer

from paperloom.llm.bpe import PATTERN, Vocabulary
from paperloom.llm.queries import QUERIES
from paperloom.llm.token_counts import Trie, count_tokens, fit_scores
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
V = Vocabulary(PATH)
LIBRARY = Tokenizer.from_file(PATH)
#: Scores by the order of the vocabulary.
WHOLE = math.log(sum(1 / (i + 1) for i in range(50256)))
SCORES = {p: -math.log(i + 1) - WHOLE for i, p in V.pieces.items() if i != 50256}


def slow(word, scores):
    """Pieces on the best path, by a table for this word alone."""
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        ways = [(-(best[a][0] + scores[word[a:d]]), best[a][1] + 1) for a in range(d) if word[a:d] in scores]
        s, n = min(ways)
        best.append((-s, n))
    return best[-1][1]


def test_trie_scores_each_prefix_once():
    rng = random.Random(1)
    words = ["".join(rng.choice("aetnsh ") for _ in range(rng.randint(1, 14))).encode() for _ in range(500)] + ["ñandú".encode(), "日本".encode()]
    trie = Trie(SCORES)
    assert [trie.count(w) for w in words] == [slow(w, SCORES) for w in words]
    assert len(trie.best) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert math.isclose(sum(math.exp(s) for s in SCORES.values()), 1.0)


def units_of(text):
    parts = (text or "").split("<|endoftext|>")
    return [u.encode() for p in parts for u in regex.findall(PATTERN, p)], len(parts) - 1


def fitted(texts):
    """Log shares of pieces in what the library encodes."""
    found = Counter(V.pieces[i] for t in texts for i in LIBRARY.encode(t or "", add_special_tokens=False).ids if i != 50256)
    total = sum(found.values()) + len(SCORES)
    return {p: math.log(found[p] + 1) - math.log(total) for p in SCORES}


def verify(rows, texts):
    scores = fitted([t for _, t in texts])
    n = functools.cache(lambda u: slow(u, scores))
    want = [(k, len(units) + special, sum(map(n, units)) + special) for k, t in texts for units, special in [units_of(t)]]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    return scores


def test_odd_rows(odd, none):
    verify([tuple(r) for r in count_tokens(odd, PATH).collect()], [(k, t) for k, t, *_ in ODD])
    assert count_tokens(none, PATH).count() == 0
    assert len(set(fit_scores(none, PATH).values())) == 1


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    scores = verify([tuple(r) for r in QUERIES["op10_token_counts"](spark, sf).collect()], docs)
    assert math.isclose(sum(math.exp(s) for s in scores.values()), 1.0)
    found = fit_scores(spark.read.parquet(f"{sf}/documents.parquet"), PATH)
    assert found.keys() == scores.keys() and all(math.isclose(found[p], s) for p, s in scores.items())
