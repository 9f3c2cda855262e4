"""SimHash near-duplicates by pivot distance tables (operator 4).

Each distinct fingerprint gets a table of its Hamming distances to reference fingerprints (pivots).
Fingerprints meet where enough of their blocks are equal, which any pair within the radius has; a pair that
meets is discarded if its table rows differ by more than the radius anywhere, since by the triangle inequality it
is then further apart; survivors are verified bit by bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import text_slices
from paperloom.llm.common import broadcast_if_small, cut, fresh, lowered, mixed, small_batches
from paperloom.llm.components import connected_components

#: Reference fingerprints of the distance table.
PIVOTS = 12
#: Fingerprints that meet at one place and are still compared with each other; larger groups go by shared neighbours.
MEETING = 64
#: Shingles that COMMON of the texts with one id in SAMPLE share come last in the order of shingles, LAST of them at most. Any order gives the same pairs.
SAMPLE, COMMON, LAST = 16, 8, 100_000
#: Rows of one side of a join that share a key and go to one task; more are dealt out by salt.
DEALT = 256
#: Longs of the parity bits of a set: for every text, and for those of the pairs that are left.
PARITIES, MORE_PARITIES = 16, 256


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased text's word shingles, repeats included; no words: 0."""
    import xxhash

    words = lowered(text).split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)] or [digest(joined, seed)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """key, fp (long) for each row. Null text is empty; its fingerprint is 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            prints = np.array([fingerprint(t.encode(), shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], names=["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col("text")).mapInArrow(run, f"key {kind}, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints by rule: successive values of a 64-bit mixing generator, as signed longs."""
    out, x = [], 0
    for _ in range(n):
        x = x + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        z = x
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        z = (z ^ z >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def meeting_masks(radius: int, blocks: int) -> list[int]:
    """Masks of blocks - radius of the blocks each: of a pair within the radius, one mask at least has equal bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [_signed(sum(c)) for c in combinations(masks, blocks - radius)]


def _not_discarded(x: Column, y: Column, radius: int) -> Column:
    """No coordinate of two rows of the distance table differs by more than the radius."""
    keep = F.lit(True)
    for i in range(PIVOTS):
        keep = keep & (F.abs(x[i] - y[i]) <= radius)
    return keep


def links_within(prints: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Links space, u, v between the distinct fingerprints of `prints` (columns space and fp), enough of them to connect all pairs within
    the radius (at most 2). Fingerprints of different spaces never meet.

    Where up to MEETING fingerprints meet, all pairs within the radius are linked. Where more do, they are linked through shared
    neighbours instead: two fingerprints are within 2 bits exactly if some value is within one bit of both, so each
    sends itself and its 64 one-bit neighbours, and those that share a value are linked to the least of them: the work
    grows in proportion, and no pairs are made.
    """
    if not 0 <= radius <= 2 < blocks:
        raise ValueError("the radius is 0, 1 or 2, and there are more blocks")
    masks = meeting_masks(radius, blocks)
    table = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()])
    places = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "place")
    placed = prints.select("space", "fp", table.alias("far"), places)
    where = ["space", "mask", "place"]
    sizes = cut(placed.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    crowded, few = sizes.filter(F.col("n") > MEETING), sizes.filter(F.col("n") <= MEETING)
    n = sizes.count()
    met = placed.join(broadcast_if_small(few.select(*where), 32, n), where, "left_semi")
    a, b = met.alias("a"), met.alias("b")
    near: Column = F.col("a.fp") < F.col("b.fp")
    for c in where:
        near = near & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pairs = a.join(b, near & _not_discarded(F.col("a.far"), F.col("b.far"), radius)).filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    pairs = pairs.select("a.space", F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    many = placed.join(broadcast_if_small(crowded.select(*where), 32, n), where, "left_semi").select("space", "fp", "far").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    near_values = many.select("space", F.struct("fp", "far").alias("x"), F.explode(flips).alias("value"))
    # at most 65 fingerprints have a value within one bit
    least = near_values.groupBy("space", "value").agg(F.min("x").alias("u"), F.collect_list("x").alias("vs")).filter(F.size("vs") > 1)
    shared = least.select("space", "u", F.explode("vs").alias("v")).filter(_not_discarded(F.col("u.far"), F.col("v.far"), radius))
    shared = shared.filter(F.bit_count(F.col("u.fp").bitwiseXOR(F.col("v.fp"))).between(1, radius))
    return pairs.union(shared.select("space", F.col("u.fp").alias("u"), F.col("v.fp").alias("v")))


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 4, key: str = "doc_id") -> DataFrame:
    """One row for each input row: key, fingerprint (16 hex digits), component_id (the smallest key reachable by links).

    Rows with the same fingerprint are one class, however many; links are sought between classes. Null and empty texts
    have fingerprint 0 and are linked like any other. A null key takes part and gets its component's smallest key; null only if the component has no other.
    Repeated rows stay, each with the same component. An empty table gives an empty result; other columns are passed over.
    """
    small_batches(docs.sparkSession)
    rows = cut(fingerprints(docs, shingle, key=key))
    classes = cut(rows.groupBy("fp").agg(F.min("key").alias("least")))
    linked = cut(connected_components(cut(links_within(classes.select(F.lit(0).alias("space"), "fp"), radius, blocks))))
    n = linked.count()
    part = classes.join(broadcast_if_small(linked.withColumnRenamed("node", "fp"), 24, n), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # only classes that have links can have a smaller key elsewhere
    moved = part.join(broadcast_if_small(linked.select(F.col("node").alias("fp")), 16, n), "fp", "left_semi")
    ids = cut(moved.join(moved.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id"))
    same = classes.join(broadcast_if_small(ids.select("fp"), 16, n), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    found = rows.join(ids.union(same), "fp")
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of the lower-cased text's word shingles, ascending; a text of fewer words has one shingle."""
    import xxhash

    words = np.array([xxhash.xxh64_intdigest(w) for w in lowered(text).split()], np.uint64)
    if not len(words):
        return words
    n = min(shingle, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return np.unique(out)


def _parities(x: np.ndarray, longs: int) -> np.ndarray:
    """For each of 64 * longs parts of all hashes, whether the set has an odd number of them."""
    return np.packbits(np.bincount((x % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1).view(np.int64)


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, the distinct hashes of the word shingles, their number and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sets = [shingle_set(t.encode(), shingle).view(np.int64) for t in texts]
            odd = [_parities(x.view(np.uint64), MORE_PARITIES) for x in sets]
            columns = [part.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int32()), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "shingles", "size", "odd"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles array<long>, size int, odd array<long>")


def _least_shared(similarity: float, size: int) -> int:
    """Shingles that a set of this size shares with any near copy."""
    return max(1, math.ceil(similarity * size - 1e-9))


def _prefixes(docs: DataFrame, similarity: float, shingle: int, last: np.ndarray) -> DataFrame:
    """id, size, a hash of the whole set, the SimHash fingerprint, parities of 64 * PARITIES parts of the set, and the first size - _least_shared + 1 shingles of the set, in the order of their hashes with
    those in `last` at the end (common: how many of the first are among these): near copies share one of these at least. Texts without words are left out."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sizes, whole, firsts, common = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int64), [], np.zeros(len(texts), np.int32)
            odd, prints = np.zeros((len(texts), PARITIES), np.int64), np.zeros(len(texts), np.uint64)
            for i, t in enumerate(texts):
                x = shingle_set(t.encode(), shingle)
                prints[i] = fingerprint(t.encode()) if len(x) else 0
                sizes[i], whole[i] = len(x), np.uint64(xxhash.xxh64_intdigest(x.tobytes())).view(np.int64)
                odd[i] = _parities(x, PARITIES)
                if len(last) and len(x):
                    late = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] == x
                    x = np.concatenate([x[~late], x[late]])
                    common[i] = max(0, len(x) - _least_shared(similarity, len(x)) + 1 - int((~late).sum()))
                firsts.append(x[: len(x) - _least_shared(similarity, len(x)) + 1].view(np.int64) if len(x) else x.view(np.int64))
            odds = pa.FixedSizeListArray.from_arrays(pa.array(odd.ravel()), PARITIES).cast(pa.list_(pa.int64()))
            columns = [part.column(0), pa.array(sizes), pa.array(whole), pa.array(prints.view(np.int64)), odds, pa.array(firsts, pa.list_(pa.int64())), pa.array(common)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "whole", "fp", "odd", "first", "common"])

    return docs.select("id", "text").mapInArrow(run, "id long, size int, whole long, fp long, odd array<long>, first array<long>, common int").filter("size > 0")


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that come last, ascending: those that many texts of a sample share. They only set the order."""
    some = _shingle_sets(docs.filter(F.pmod("id", F.lit(SAMPLE)) == 0), shingle).select(F.explode("shingles").alias("token"))
    counted = some.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    tokens = [r.token for r in counted.orderBy(F.desc("n"), "token").limit(LAST).collect()]  # LAST rows at most
    return np.sort(np.array(tokens, np.int64).view(np.uint64))


def _with_sets(pairs: DataFrame, side: str, sets: DataFrame, name: str) -> DataFrame:
    """pairs with the set of their `side`; a text in many pairs has its set repeated, and its pairs dealt out by salt."""
    other = "b" if side == "a" else "a"
    salts = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("salts"))
    many = cut(salts.filter("salts > 1"))
    wide = broadcast_if_small(many, 16, many.count())
    dealt = pairs.join(wide, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1)))).drop("salts")
    held = sets.select(F.col("id").alias(side), F.col("shingles").alias(name)).join(wide, side, "left")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
    return dealt.join(held, [side, "salt"]).drop("salt")


def _possible(pairs: DataFrame, prints: DataFrame, similarity: float, longs: int = PARITIES) -> DataFrame:
    """The pairs that may be alike: each parity in which two sets differ is a shingle that only one of them has."""
    ends = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    n = ends.count()
    bits = cut(prints.select("id", "size", "odd").join(broadcast_if_small(ends, 16, n), "id", "left_semi"))
    one, two = (broadcast_if_small(bits.select(F.col("id").alias(x), F.struct("size", "odd").alias(y)), 40 + 8 * longs, n) for x, y in (("a", "x"), ("b", "y")))
    if longs > PARITIES:
        differ = F.aggregate(F.zip_with("x.odd", "y.odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    else:
        differ = sum((F.bit_count(F.col("x.odd")[i].bitwiseXOR(F.col("y.odd")[i])) for i in range(longs)), F.lit(0))
    most = (1 - similarity) / (1 + similarity) * (F.col("x.size") + F.col("y.size")) + 1e-9
    return cut(pairs.join(one, "a").join(two, "b").filter(differ <= most).select("a", "b"))


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float, shingle: int, repeats: bool) -> DataFrame:
    """u and v of the pairs a, b whose sets are alike by `similarity`. repeats: docs may have several rows of one id."""
    ends = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = _shingle_sets(docs.join(broadcast_if_small(ends, 16, ends.count()), "id", "left_semi"), shingle)
    sets = cut(sets.dropDuplicates(["id"]) if repeats else sets)
    pairs = _possible(pairs, sets, similarity, MORE_PARITIES)
    left = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    sets = sets.join(broadcast_if_small(left, 16, left.count()), "id", "left_semi")
    both = _with_sets(_with_sets(pairs, "a", sets, "x"), "b", sets, "y")
    shared = F.size(F.array_intersect("x", "y"))
    near = both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9)
    return cut(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


# What travels with a shingle of a text, in one number: the size of its set, whether the shingle is a common one, and its place.
_COMMON_BIT, _PLACE = 1 << 31, (1 << 31) - 1


def _met(places: DataFrame, similarity: float) -> DataFrame:
    """The rows of places (token, id, sized) that have another one of the same token and a size that leaves room for the similarity.

    One shuffle; rows come in order of token and size, where the closest sizes are neighbours, so no group is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, and whether the one before it was close
        known = False
        for batch in batches:
            if not len(batch):
                continue
            whole = batch if held is None else pa.concat_batches([held, batch])
            token, size = whole.column(0).to_numpy(zero_copy_only=False), whole.column(2).to_numpy(zero_copy_only=False) >> 32
            close = (token[1:] == token[:-1]) & (size[:-1] >= similarity * size[1:] - 1e-9)
            met = np.zeros(len(token), bool)
            met[1:] = close
            met[:-1] |= close
            met[0] |= known
            yield whole.slice(0, len(whole) - 1).filter(pa.array(met[:-1]))
            held, known = whole.slice(len(whole) - 1), bool(met[-1])
        if held is not None and known:
            yield held

    return places.repartition("token").sortWithinPartitions("token", "sized").mapInArrow(run, "token long, id long, sized long")


def _room(x: tuple[Column, Column], y: tuple[Column, Column], similarity: float) -> Column:
    """Whether the sizes of two sets, and the places of the first shingle that they share, leave room for the similarity. x, y: size and place."""
    needed = similarity / (1 + similarity) * (x[0] + y[0]) - 1e-9
    return F.least(x[0] - x[1], y[0] - y[1], x[0], y[0]) >= needed


def _size_place(sized: Column) -> tuple[Column, Column]:
    return F.shiftright(sized, 32), sized.bitwiseAND(F.lit(_PLACE))


def _stars(central: DataFrame, similarity: float) -> DataFrame:
    """a and b: the pairs of the first row of each token, by rank and id, and the others of it whose sizes and places leave room for the similarity.

    central: token, id, sized, rank. Other tokens: one shuffle, rows come in order and no group is held. Common tokens, LAST at most: their first rows are found
    by task first and broadcast.
    """
    needed = similarity / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple[int, ...] | None = None
        for batch in batches:
            if not len(batch):
                continue
            token, id_, sized = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            size, room = sized >> 32, (sized >> 32) - (sized & _PLACE)
            start = np.ones(len(token), bool)
            start[1:] = token[1:] != token[:-1]
            start[0] = hub is None or hub[0] != int(token[0])
            first = np.flatnonzero(start)
            at = np.cumsum(start) - 1
            # rows before the first start go on with the hub of the batch before
            from_ = first[np.maximum(at, 0)] if len(first) else np.zeros(len(at), np.int64)
            hubs = [np.where(at < 0, hub[k + 1] if hub else 0, column[from_]) for k, column in enumerate((id_, size, room))]
            ok = (id_ != hubs[0]) & (np.minimum(np.minimum(room, hubs[2]), np.minimum(size, hubs[1])) >= needed * (size + hubs[1]) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(id_, hubs[0])[ok]), pa.array(np.maximum(id_, hubs[0])[ok])], names=["a", "b"])
            if len(first):
                k = int(first[-1])
                hub = (int(token[k]), int(id_[k]), int(size[k]), int(room[k]))

    common = F.col("sized").bitwiseAND(F.lit(_COMMON_BIT)) != 0
    rare = central.filter(~common).select("token", "id", "sized", "rank").repartition("token").sortWithinPartitions("token", "rank", "id")
    often = central.filter(common)
    hubs = F.broadcast(cut(often.groupBy("token").agg(F.min(F.struct("rank", "id", "sized")).alias("hub"))))  # LAST rows at most
    near = often.join(hubs, "token").filter(F.col("id") != F.col("hub.id")).filter(_room(_size_place(F.col("sized")), _size_place(F.col("hub.sized")), similarity))
    pairs = near.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b"))
    return rare.mapInArrow(run, "a long, b long").union(pairs).distinct()


def simhash_pairs(prints: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """a < b: pairs of ids (prints: id, fp) that connect all whose fingerprints are one or link within the radius, by pivot distance tables.

    A fingerprint's texts meet the one of them with the smallest id; linked fingerprints' smallest ids meet each other.
    """
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    n = classes.count()
    least = broadcast_if_small(classes, 24, n)
    links = cut(links_within(classes.select(F.lit(0).alias("space"), "fp"), radius, blocks))
    u, v = (least.select(F.col("fp").alias(end), F.col("least").alias(to)) for end, to in (("u", "p"), ("v", "q")))
    between = links.join(u, "u").join(v, "v").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    within = prints.join(least, "fp").filter("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    return between.union(within).distinct()


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs a, b that are not in one group (groups: node, component) yet."""
    n = groups.count()
    p, q = (broadcast_if_small(groups.select(F.col("node").alias(end), F.col("component").alias(to)), 24, n) for end, to in (("a", "p"), ("b", "q")))
    return pairs.join(p, "a", "left").join(q, "b", "left").filter(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")


def near_copy_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, key: str = "doc_id") -> DataFrame:
    """id and component (its smallest id) for rows that have a near copy. id: xxhash64 of key and text.

    Two texts are near copies if their sets of `shingle`-word shingles have a Jaccard similarity of `similarity` or more; groups are the
    connected components of all such pairs, and no pair is missed. Texts of equal sets are one. Candidates come by SimHash pivot distance tables
    first, as in near_groups; each is verified by its sets, and what they find is grouped. Fingerprints within the radius miss some pairs just above the
    similarity, so the rest follows exactly: near copies share a shingle among the first of both sets
    in a common order (prefix filter), so only texts that share such a shingle, are not in one group yet, and whose sizes and places of it leave room
    for the similarity, are candidates. First each text is verified against one text of each shared shingle,
    the one with the fewest shingles of its own; then all candidates that are not in one group by then are verified as well. A pair that is
    never verified is in one group already. Rows that repeat key and text are one.
    """
    text = F.coalesce("text", F.lit(""))
    ided = docs.select(F.xxhash64(F.col(key), text).alias("id"), text.alias("text"))
    small_batches(docs.sparkSession)
    prints = cut(_prefixes(ided, similarity, shingle, _common(ided, shingle)))
    repeats = prints.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0
    prints = cut(prints.dropDuplicates(["id"])) if repeats else prints
    same = cut(prints.groupBy("whole", "size").agg(F.min("id").alias("rep"), F.max("id").alias("most")).filter("rep != most"))
    copies = cut(prints.join(broadcast_if_small(same.drop("most"), 24, same.count()), ["whole", "size"]).filter("id != rep").select("rep", "id"))
    alone = prints.join(broadcast_if_small(copies.select("id"), 16, copies.count()), "id", "left_anti")

    links = copies.select(F.col("rep").alias("u"), F.col("id").alias("v"))
    alike = cut(simhash_pairs(alone.select("id", "fp")))
    links = links.union(_verified(_possible(alike, prints, similarity), ided, similarity, shingle, repeats))
    groups = cut(connected_components(cut(links)))

    places = alone.select("id", "size", (F.size("first") - F.col("common")).alias("rare"), F.posexplode("first").alias("at", "token"))
    common = F.col("at") >= F.col("rare")
    sized = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.when(common, F.lit(_COMMON_BIT)).otherwise(F.lit(0)).cast("long")).bitwiseOR(F.col("at").cast("long"))
    # common shingles are known to be shared, so a shingle that a third of all texts have needs no look at all of its rows
    met = _met(places.filter(~common).select("token", "id", sized.alias("sized")), similarity)
    met = cut(met.union(places.filter(common).select("token", "id", sized.alias("sized"))))
    lone = cut(met.groupBy("id").agg(F.count(F.lit(1)).alias("n")))
    size = F.shiftright("sized", 32)
    firsts = size - F.greatest(F.lit(1), F.ceil(similarity * size - 1e-9)) + 1
    central = met.join(broadcast_if_small(lone, 24, lone.count()), "id").withColumn("rank", firsts - F.col("n"))
    tried = cut(_apart(_stars(central, similarity), groups))
    links = links.union(_verified(_possible(tried, prints, similarity), ided, similarity, shingle, repeats))

    groups = cut(connected_components(cut(links)))
    placed = met.join(broadcast_if_small(groups, 24, groups.count()), met["id"] == groups["node"], "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.select("token", "id", "component", "sized")
    apart = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo != hi")
    # as many as the corpus has, so they are never broadcast here
    open_ = placed.join(apart.select("token", F.ceil(F.col("n") / DEALT).cast("int").alias("salts")), "token")
    open_ = cut(open_.select("token", "id", "component", "sized", "salts"))
    c = F.col
    one = open_.withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int")).alias("one")
    two = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("two")
    (m, _), (n, _) = x, y = _size_place(c("one.sized")), _size_place(c("two.sized"))
    smaller = (m < n) | ((m == n) & (c("one.id") < c("two.id")))
    on = (c("one.token") == c("two.token")) & (c("one.salt") == c("two.salt")) & (c("one.component") != c("two.component"))
    rest = one.join(two, on & smaller & _room(x, y, similarity)).select(F.least("one.id", "two.id").alias("a"), F.greatest("one.id", "two.id").alias("b")).distinct()
    rest = cut(rest.join(tried.union(alike), ["a", "b"], "left_anti"))
    near = _verified(_possible(rest, prints, similarity), ided, similarity, shingle, repeats)
    return connected_components(cut(links.union(near))).select(F.col("node").alias("id"), "component")


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near copies, the one whose id is smallest; columns as they were, whatever their names.

    Rows without words, null texts included, have no near copies and stay; a null key counts like any other; rows that repeat key and text stay or go together; an empty table stays empty.
    """
    own, other = fresh(docs, "own_id", "gone_id")
    gone = cut(near_copy_groups(docs, similarity, shingle, key=key).filter("id != component").select(F.col("id").alias(other)))
    marked = docs.withColumn(own, F.xxhash64(F.col(key), F.coalesce("text", F.lit(""))))
    return marked.join(broadcast_if_small(gone, 16, gone.count()), F.col(own) == F.col(other), "left_anti").select(*docs.columns)
