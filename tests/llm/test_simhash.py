import random
from collections import defaultdict

import pytest
import xxhash

from paperloom.llm import simhash
from paperloom.llm.components import connected_components
from paperloom.llm.queries import QUERIES
from paperloom.llm.simhash import drop_near_copies, fingerprint, links_within, near_groups
from tests.llm.conftest import ODD


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Over distinct values, by comparing all pairs."""
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return {p: root(p) for p in values}


def expected(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    comp = components(set(prints))
    least = defaultdict(list)
    for (key, _), p in zip(rows, prints):
        if key is not None:
            least[comp[p]].append(key)
    return sorted(repr((key, f"{p:016x}", min(least[comp[p]], default=None))) for (key, _), p in zip(rows, prints))


def test_fingerprint():
    for text in ["", "  \n", "One", "one two", "A b c", "a b c d a b c d A B C D é É"]:
        assert fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_as_all_pairs_do(spark, seed):
    rng = random.Random(seed)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        prints |= {p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(8)}
    hub = rng.getrandbits(64)
    prints |= {hub ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(300)}  # crowded places
    signed = [(0, p - (1 << 64) if p >> 63 else p) for p in prints]
    links = links_within(spark.createDataFrame(signed, "space int, fp long")).collect()
    mask = (1 << 64) - 1
    assert all((r.u & mask ^ r.v & mask).bit_count() <= 2 for r in links)
    found = {r.node & mask: r.component & mask for r in connected_components(spark.createDataFrame([(r.u, r.v) for r in links], "u long, v long")).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for p, c in components(prints).items():
        want[c].add(p)
        got[found.get(p, p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    random.Random(4).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {1000: 1000, 1001: 1000}


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in near_groups(odd).collect()]
    assert sorted(map(repr, got)) == expected([(k, t) for k, t, *_ in ODD])
    assert near_groups(none).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, sf).collect()]
    assert sorted(map(repr, got)) == expected(rows)


def test_near_copies_by_shingles(spark):
    """Planted copies against all pairs: what goes has a near copy, and nearly all near copies go."""
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(40, 300))]
        texts.append(words)
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, len(words) // 50)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(copy)
    rows = [(i, " ".join(w), "x") for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    kept = {r.doc_id for r in kept.collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    near = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    have = {x for p in near for x in p}
    assert {i for i in range(len(texts)) if i not in have} <= kept
    left = [p for p in near if set(p) <= kept]
    assert len(left) <= 0.05 * len(near)


def test_near_copies_of_odd_rows(odd, none):
    assert {r.doc_id for r in drop_near_copies(odd).collect()} >= {3, 7, 8, 9, None}
    assert drop_near_copies(odd).columns == odd.columns
    assert drop_near_copies(none).count() == 0


def test_near_copies_alike_to_an_original_only(spark):
    """Copies that are 0.8 alike to their original and not to each other, many at each shared shingle: one row of the group stays."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = [words]
    for c in range(300):
        copy = list(words)
        for k, at in enumerate(rng.sample(range(10, 190, 6), 3)):
            copy[at] = f"new{c}x{k}"
        texts.append(copy)
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, " ".join(texts[i])) for i in order], "doc_id long, text string")
    assert drop_near_copies(docs).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_all_near_copies_just_above_the_similarity(spark, seed):
    """Pairs edited with a new word each time, most between 0.8 and 0.9 alike, among boilerplate that many texts share: each group keeps one row."""
    rng = random.Random(seed)
    footer = [f"foot{i}" for i in range(8)]
    texts = []
    for t in range(120):
        words = [rng.choice(footer) if rng.random() < 0.02 else f"t{t}w{rng.randrange(400)}" for _ in range(rng.randint(3, 300))]
        words += footer if t % 2 else []
        texts.append(words)
        for c in range(rng.randint(1, 2)):
            copy = list(words)
            for k in range(rng.randint(0, 1 + len(words) // 45)):
                copy[rng.randrange(len(copy))] = f"new{t}x{c}x{k}"
            texts.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    just = sum(len(sets[a] & sets[b]) < 0.9 * len(sets[a] | sets[b]) for a, b in near)
    assert just >= 40
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[root(a)] = root(b)
    kept = [r.doc_id for r in drop_near_copies(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()]
    assert sorted(root(i) for i in kept) == sorted(i for i in range(len(sets)) if root(i) == i)


def test_pipeline_candidates_come_by_fingerprints(spark, monkeypatch):
    """The pairs that the pipeline's step verifies first are those that pivot tables link; without room for others, near copies within the radius still go."""
    rng = random.Random(5)
    texts = [[f"t{t}w{i}" for i in range(300)] for t in range(20)]
    texts += [[*words[:k], "new", *words[k + 1 :]] for words in texts for k in (rng.randrange(10, 290),)]
    prints = [slow_fingerprint(" ".join(w)) for w in texts]
    linked = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (prints[a] ^ prints[b]).bit_count() <= 2}
    assert len(linked) >= 5
    ids = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, fp long")
    assert {(r.a, r.b) for r in simhash.simhash_pairs(ids).collect()} == linked
    monkeypatch.setattr(simhash, "_met", lambda places, similarity: places.limit(0))  # no shingle is shared, so no other candidates
    kept = {r.doc_id for r in drop_near_copies(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()}
    assert len(kept) == len(texts) - len(linked) and not any({a, b} <= kept for a, b in linked)


def test_rounds_of_few_edges_take_few_files(spark, monkeypatch):
    """Pipeline on check_h: few edges are one partition after the first cut, and no round deals them out again, however many partitions shuffles have; more edges give the same."""
    from paperloom.llm import components

    edges = [(i, i + 1) for i in range(0, 40) if i % 9] + [(100 + i % 3, 200 + i) for i in range(20)] + [(7, 7), (5, 4), (5, 4)]
    table = spark.createDataFrame(edges, "u long, v long").repartition(7)
    parts, written = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: parts.append(df.rdd.getNumPartitions()) or written(df))
    got = sorted(map(tuple, components.connected_components(table).collect()))
    assert set(parts[1:]) == {1}
    parts.clear()
    monkeypatch.setattr(components, "FEW", 3)
    assert got == sorted(map(tuple, components.connected_components(table).collect()))
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    assert got == sorted((x, root(x)) for x in parent)
