import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm.packing import Knapsack, Words, configurations, large_plan, pack, pieces, sequences, size_groups, small_plan
from paperloom.llm.queries import QUERIES
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows, capacity):
    out = []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out += [(key, k // capacity, k, len(ids[k : k + capacity]), np.array(ids[k : k + capacity], "<u4").tobytes()) for k in range(0, len(ids), capacity)]
    return out


def whole(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity; gives their number."""
    by = defaultdict(list)
    for sequence_id, offset, length in rows:
        by[sequence_id].append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    """A plain best-fit decreasing loop."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return rooms


def test_words_like_the_library(library):
    texts = ["", " ", "It's WE'LL 'd--'s", "á ́b", "İstanbul ΣΑΣ ﬁ", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "tab\tnew\nline\r\x0b\x1c\x85z", "日本語 🙂🙂 12½", "A,B.C;1234 " * 30, "　wide　 nbsp"]
    rng = random.Random(3)
    texts += [f"{c}a {c} A{c}'s{c}1" for c in map(chr, range(33, 0x260)) if c.isprintable()]
    texts += ["".join(rng.choice("aB'sdt. ,1ü\n<|>") for _ in range(80)) for _ in range(200)]
    own = Words(PATH)
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_knapsack_is_best():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes, capacity = np.unique(rng.integers(5, 30, 4)), int(rng.integers(30, 60))
        values = rng.random(len(sizes))
        best = [0.0] * (capacity + 1)
        for room in range(1, capacity + 1):
            best[room] = max([0.0, *[best[room - s] + v for s, v in zip(sizes.tolist(), values) if s <= room]])
        config, value = Knapsack(sizes, capacity).best(values)
        assert value == pytest.approx(best[capacity]) == pytest.approx(config @ values) and config @ sizes <= capacity


def test_groups_are_of_like_cardinality():
    counts = np.random.default_rng(1).integers(0, 50, 401)
    groups = size_groups(counts, 100, 20)
    assert len(groups) <= 20 and sum(n for *_, n in groups) == counts[100:].sum()
    assert max(n for *_, n in groups) < counts[100:].sum() / 20 + 50
    assert [low for low, *_ in groups][:-1] > [high for _, high, _ in groups][1:]


def test_configurations_meet_the_demand():
    rng = np.random.default_rng(2)
    for k in (1, 3, 12):
        sizes = np.sort(rng.choice(np.arange(340, 1001), k, replace=False))[::-1]
        demand = rng.integers(1, 900, k)
        plan = configurations(sizes, demand, 1000)
        assert (sum(c * n for c, n in plan) == demand).all() and all(c @ sizes <= 1000 for c, _ in plan)
    # pairs that fill a sequence exactly are found
    plan = configurations(np.array([700, 600, 400, 300]), np.array([50, 80, 80, 50]), 1000)
    assert sum(n for _, n in plan) == 130


def test_plans_are_as_good_as_a_plain_loop():
    rng = np.random.default_rng(9)
    for n in (3, 40, 600):
        lengths = rng.integers(1, 101, n)
        lengths[: n // 3] = 37  # one length holds a third
        counts = np.bincount(lengths, minlength=101)
        large = large_plan(counts, 100, 34)
        fill = defaultdict(list)
        for size in range(34, 101):
            for place in range(counts[size]):
                key = large["group"][size] << 40 | large["before"][size] + place
                at = np.searchsorted(large["key"], key, "right") - 1
                fill[int(large["bin"][at] + key - large["key"][at])].append((int(large["slot"][at]), size))
        assert all(sum(s for _, s in own) <= 100 and len({slot for slot, _ in own}) == len(own) for own in fill.values())
        gaps = np.bincount([100 - sum(s for _, s in own) for own in fill.values()], minlength=101)
        plan = small_plan(np.where(np.arange(101) < 34, counts, 0), gaps, 100)
        rows = []
        for size in range(1, 34):
            for place in range(counts[size]):
                at = np.searchsorted(plan["key"], size << 40 | place, "right") - 1
                number, k = divmod((size << 40 | place) - int(plan["key"][at]), int(plan["each"][at]))
                rows.append(((int(plan["own"][at]), int(plan["low"][at]) + number), int(plan["used"][at]) + k * size, size))
        heads = [((gap, i), 0, 100 - gap) for gap in range(100) for i in range(gaps[gap])] + [((0, -1 - i), 0, 100) for i in range(0)]
        used = whole(rows + heads, 100)
        assert used <= len(best_fit(lengths.tolist(), 100)) * 1.02 + 1


@pytest.mark.parametrize("capacity", [8, 4096])
def test_odd_rows(odd, none, library, capacity):
    got = pieces(odd, PATH, capacity=capacity)
    want = expected(library, [(r[0], r[1]) for r in ODD], capacity)
    assert sorted(map(repr, [(r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got.collect()])) == sorted(map(repr, want))
    packed = pack(got, ["doc_id", "piece"], capacity)
    rows = packed.collect()
    assert sorted(map(repr, [(r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows])) == sorted(map(repr, want))
    n = whole([(r.sequence_id, r.offset, r.length) for r in rows], capacity)
    assert n <= len(best_fit([w[3] for w in want], capacity)) + 1
    made = {r.sequence_id: (bytes(r.ids), r.starts) for r in sequences(packed).collect()}
    assert len(made) == n
    for r in rows:
        ids, starts = made[r.sequence_id]
        assert ids[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and r.offset in starts
    assert pack(pieces(none, PATH), ["doc_id"]).count() == 0


def test_other_columns_and_lengths_out_of_range(spark):
    rows = spark.createDataFrame([(i, 5, "x", "y") for i in range(7)], "place long, length long, gap string, bin string")
    got = pack(rows, ["place"], capacity=10)
    assert got.columns == ["place", "length", "gap", "bin", "sequence_id", "offset"]
    assert whole([(r.sequence_id, r.offset, r.length) for r in got.collect()], 10) == 4
    with pytest.raises(ValueError):
        pack(rows.withColumn("length", F.lit(0)), ["place"])
    with pytest.raises(IndexError):
        pack(rows.withColumn("length", F.lit(11)), ["place"], capacity=10)


def test_query(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = expected(library, docs, 4096)
    rows = QUERIES["op11_best_fit_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((*w[:4], zlib.crc32(w[4])) for w in want)
    assert whole([(r.sequence_id, r.offset, r.length) for r in rows], 4096) <= -(-sum(w[3] for w in want) // 4096) * 1.01 + 1
    again = QUERIES["op11_best_fit_packing"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
