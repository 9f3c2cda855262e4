import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm.bpe import Codec, Vocabulary, encode_decode, pair_indexed_ids
from paperloom.llm.queries import QUERIES
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pair_index_merges_like_a_word_by_word_loop():
    v, rng = Vocabulary(PATH), random.Random(5)
    words = ["".join(rng.choice("aabthe ") for _ in range(rng.randint(1, 12))).encode() for _ in range(400)]

    def one(word):
        ids = [v.single[b] for b in word]
        while True:
            ranked = [(v.merges[a << 20 | b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 20 | b in v.merges]
            if not ranked:
                return ids
            _, i = min(ranked)
            ids[i : i + 2] = [v.merges[ids[i] << 20 | ids[i + 1]][1]]

    assert [np.frombuffer(x, "<u4").tolist() for x in pair_indexed_ids(words, v)] == [one(w) for w in words]


def test_pieces_with_odd_spaces(library):
    texts = ["", "  a  b ", " ", "\n\n x\t y  ", "a<|endoftext|>b  <|endoftext|>  c", "aaaaaaa aaaa", "it's we'll  'd", " x  y \x1c z \x85", "日本語 123 ½", "x \n y", "　 　"]
    codec = Codec(PATH)
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text)
        assert codec.decode(ids) == library.decode(ids_of(library, text), skip_special_tokens=False)


def test_odd_rows(odd, none, library):
    got = sorted(map(repr, [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in encode_decode(odd, PATH).collect()]))
    want = []
    for key, text, *_ in ODD:
        ids = ids_of(library, text)
        want.append((key, len(ids), np.array(ids, "<u4").tobytes(), text or ""))
    assert got == sorted(map(repr, want))
    assert encode_decode(none, PATH).count() == 0


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_bpe_encode_decode"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = ids_of(library, docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
