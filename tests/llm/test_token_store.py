import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paperloom.llm.queries import QUERIES
from paperloom.llm.token_store import Shard, encode_levels, read_tokens, write_tokens
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(map(repr, out))


def test_any_token_by_itself():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 200, 3000), rng.integers(0, 60000, 5000), rng.integers(0, 2**32, 2000), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype("<u4")
    rng.shuffle(ids)
    shard = Shard(encode_levels(ids))
    assert [shard.token(i) for i in range(len(ids))] == ids.tolist()
    for i, j in [(0, len(ids)), (5, 5), (13, 4097), (512, 1024), (9999, 10006)]:
        assert shard.tokens(i, j).tolist() == ids[i:j].tolist()


def test_odd_rows(spark, odd, none, tmp_path):
    write_tokens(odd, PATH, str(tmp_path / "a"))
    got = [(r.key, r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, str(tmp_path / "a")).collect()]
    assert sorted(map(repr, got)) == expected([(k, t) for k, t, *_ in ODD])
    write_tokens(none, PATH, str(tmp_path / "b"))
    assert read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_store"](spark, sf).collect()]
    assert sorted(map(repr, got)) == expected(rows)
