"""Similar wordings: pair scores, threshold pairs, greedy clusters (H1-H6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from paperloom.operators.candidates import by_index, jaccard_features, jaccard_meets, token_set_features, token_set_meets, tokens
from paperloom.sources.checkpoints import BROADCAST_BYTES, broadcast_if_small, cut, new_folder
from paperloom.sources.files import files_of

Scorer = Callable[[Column, Column], Column]


def _codes(texts: list[str], width: int, filler: int) -> np.ndarray:
    """One row of code points a text, filled up to the width."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), filler, "<u4")
    out[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return out


#: Letters compared at a time.
COMPARED = 4_000_000


def _lcs_of_like_lengths(a: list[str], b: list[str]) -> np.ndarray:
    words = max(1, -(-max(map(len, a)) // 64))
    # fillers are no code points and differ, so they match nothing
    rows, columns = _codes(a, 64 * words, 0x110000), _codes(b, max(map(len, b)), 0x110001)
    state = np.full((len(a), words), 2**64 - 1, np.uint64)
    for j in range(columns.shape[1]):
        match = np.packbits(rows == columns[:, j : j + 1], axis=1, bitorder="little").view("<u8")
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            old, hit = state[:, w], state[:, w] & match[:, w]
            total = old + hit
            grown = total + carry
            carry = ((total < old) | (grown < total)).astype(np.uint64)
            state[:, w] = grown | (old & ~match[:, w])
    return np.bitwise_count(~state).sum(axis=1).astype(np.int64)


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts. A row of the usual table is kept as bits; a step takes the next letter of all second texts at once."""
    out = np.zeros(len(a), np.int64)
    order = sorted((k for k in range(len(a)) if a[k] and b[k]), key=lambda k: (-(-len(a[k]) // 64), len(b[k])))
    at = 0
    while at < len(order):
        width = 64 * -(-len(a[order[at]]) // 64)
        end = min(len(order), at + max(1, COMPARED // width))
        while 64 * -(-len(a[order[end - 1]]) // 64) > width or len(b[order[end - 1]]) > 2 * len(b[order[at]]) + 8:
            end = at + (end - at) // 2 if end - at > 1 else at + 1
        part = order[at:end]
        out[part] = _lcs_of_like_lengths([a[k] for k in part], [b[k] for k in part])
        at = end
    return out


@F.pandas_udf(LongType())
def _lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, y in batches:
        yield pd.Series(lcs_lengths(x.tolist(), y.tolist()))


# else a filter on the score would run it once more
_lcs = _lcs.asNondeterministic()


def token_set(a: Column, b: Column) -> Column:
    """H2: the token-set ratio in 0..1; 0 if either text has no tokens. Built-in functions but for the common subsequence of the tokens that only one side has."""
    x, y = tokens(F.coalesce(a, F.lit(""))), tokens(F.coalesce(b, F.lit("")))
    joined = lambda t: F.array_join(F.array_sort(t), " ")
    both, only_a, only_b = joined(F.array_intersect(x, y)), joined(F.array_except(x, y)), joined(F.array_except(y, x))
    s, p, q = F.length(both), F.length(only_a), F.length(only_b)
    k = F.when(s > 0, 1).otherwise(0)
    by_letters = 1 - (p + q - 2 * _lcs(only_a, only_b)) / (2 * (s + k) + p + q)
    by_tokens = F.when(s > 0, F.greatest(1 - (k + p) / (2 * s + k + p), 1 - (k + q) / (2 * s + k + q))).otherwise(0.0)
    score = F.when((s > 0) & ((p == 0) | (q == 0)), 1.0).otherwise(F.greatest(by_letters, by_tokens))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(score)


def token_jaccard(a: Column, b: Column) -> Column:
    """H1: another scorer, of built-in functions only."""
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def token_set_bound(a: Column, b: Column) -> Column:
    """No less than the token-set ratio, by built-in functions: the part of it that needs a common subsequence is bounded by the lengths of what
    isn't shared and by the characters that stand on one side only."""
    x, y = tokens(a), tokens(b)
    joined = lambda t: F.array_join(F.array_sort(t), " ")
    pieces = F.transform(F.array(F.struct(joined(F.array_intersect(x, y)).alias("s"), joined(F.array_except(x, y)).alias("p"), joined(F.array_except(y, x)).alias("q"))), _bound_of)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.get(pieces, F.lit(0)))


def _bound_of(c: Column) -> Column:
    s, p, q = (F.length(c[n]) for n in ("s", "p", "q"))
    k = F.when(s > 0, 1).otherwise(0)
    rest = lambda x, y: F.length(F.call_function("translate", c[x], F.concat(c[y], F.lit(" ")), F.lit("")))
    odd = rest("p", "q") + rest("q", "p")
    by_tokens = F.when(s > 0, F.greatest(1 - (k + p) / (2 * s + k + p), 1 - (k + q) / (2 * s + k + q))).otherwise(0.0)
    return F.when((s > 0) & ((p == 0) | (q == 0)), 1.0).otherwise(F.greatest(by_tokens, 1 - F.greatest(F.abs(p - q), odd) / (2 * (s + k) + p + q)))


#: Groups of a session up to which all of them meet; in a larger session an index finds the pairs that can be similar.
SMALL = 256
#: Without an index a larger session is dealt out in blocks of so many groups.
BLOCK = 256


def _numbered(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct wordings (w, text), and groups as session_id, idx, w."""
    words = cut(groups.select(F.col("canonical_text").alias("text")).distinct().withColumn("w", F.monotonically_increasing_id()))
    return words, groups.join(words, F.col("canonical_text") == F.col("text")).select("session_id", "idx", "w")


def scored_pairs(pairs: DataFrame, words: DataFrame, scorer: Scorer, threshold: float, bound: Scorer | None = None) -> DataFrame:
    """a, b and score of pairs of numbers of wordings at or above the threshold. bound: no less than the score; pairs whose bound is below the threshold aren't scored."""
    pairs, cores = cut(pairs), words.sparkSession.sparkContext.defaultParallelism
    # few pairs may lie in few partitions, but each is work
    if pairs.rdd.getNumPartitions() < cores:
        pairs = pairs.repartition(cores)
    small = broadcast_if_small(words, 200)
    texts = pairs.join(small.select(F.col("w").alias("a"), F.col("text").alias("x")), "a").join(small.select(F.col("w").alias("b"), F.col("text").alias("y")), "b")
    if bound is not None:
        texts = texts.filter(bound(F.col("x"), F.col("y")) >= threshold - 1e-9)
    # numbers of wordings say nothing of their order; scores may depend on which text is first
    first, second = F.least("x", "y"), F.greatest("x", "y")
    return texts.select("a", "b", scorer(first, second).alias("score")).filter(F.col("score") >= threshold)


def _all_of_small(placed: DataFrame) -> DataFrame:
    """session_id, i, j, a, b: all pairs of sessions that are small."""
    one, two = placed.select("session_id", F.col("idx").alias("i"), F.col("w").alias("v")), placed.select("session_id", F.col("idx").alias("j"), "w")
    return one.join(two, "session_id").filter("i < j").select("session_id", "i", "j", F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"))


def _all_of_large(placed: DataFrame) -> DataFrame:
    """As _all_of_small; a session's groups are dealt out in blocks, and a block meets each other one in a task of its own."""
    size = placed.groupBy("session_id").agg((F.floor((F.count(F.lit(1)) - 1) / BLOCK) + 1).cast("int").alias("blocks"))
    dealt = placed.join(broadcast_if_small(cut(size), 16), "session_id").withColumn("block", F.col("idx") % F.col("blocks"))
    one = dealt.select("session_id", "idx", "w", F.col("block").alias("p"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("q")).alias("one")
    two = dealt.select("session_id", "idx", "w", F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("block").alias("q")).alias("two")
    c = F.col
    met = one.join(two, ["session_id", "p", "q"]).filter((c("p") < c("q")) | (c("one.idx") < c("two.idx")))
    return met.select("session_id", F.least("one.idx", "two.idx").alias("i"), F.greatest("one.idx", "two.idx").alias("j"), F.least("one.w", "two.w").alias("a"), F.greatest("one.w", "two.w").alias("b"))


def candidate_pairs(placed: DataFrame, words: DataFrame, threshold: float, index: tuple | None) -> DataFrame:
    """session_id, i, j, a, b: pairs of places i < j in a session and their wordings a <= b, all pairs at or above the threshold among them.

    All groups of a session of up to SMALL meet, which is no more than SMALL / 2 pairs a group. In larger sessions those meet that the index (features and the
    condition on them, of the scorer) brings together; for a scorer without index, or a threshold below its reach, all of them.
    """
    sizes = cut(placed.groupBy(F.col("session_id").alias("of")).count().filter(F.col("count") > SMALL).select("of"))
    if not sizes.count():
        return _all_of_small(placed)
    told = placed.join(broadcast_if_small(sizes, 16), F.col("session_id") == F.col("of"), "left").select("session_id", "idx", "w", F.col("of").isNotNull().alias("big"))
    small, large = told.filter("not big").drop("big"), cut(told.filter("big").drop("big"))
    features = index[0](words.join(large.select("w").distinct(), "w", "left_semi"), threshold) if index else None
    found = _all_of_large(large) if features is None else cut(by_index(large, features, index[1], threshold))
    return _all_of_small(small).unionByName(found)


#: The index of each scorer: its features, and the condition on two wordings that have one in common.
TOKEN_SET_INDEX = (token_set_features, token_set_meets)
JACCARD_INDEX = (jaccard_features, jaccard_meets)


def similar_pairs(groups: DataFrame, scorer: Scorer = token_set, threshold: float = 0.84, bound: Scorer | None = token_set_bound, index: tuple | None = TOKEN_SET_INDEX) -> DataFrame:
    """H3: session_id, i, j (places in the session, i < j) and score of groups (session_id, idx, canonical_text) at or above the threshold.

    Candidates meet as numbers of wordings; wordings recur across sessions, so each distinct pair of them is scored once, whatever sessions it comes up in.
    bound and index belong to the scorer: bound prunes before it, index makes the candidates of large sessions; None for scorers without.
    """
    words, placed = _numbered(groups)
    placed = cut(placed)
    n, met = words.count(), placed.groupBy("session_id").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    if n * (n - 1) / 2 <= (met or 0):
        return _by_wording(words, placed, scorer, threshold, bound, index)
    pairs = candidate_pairs(placed, words, threshold, index)
    scores = cut(scored_pairs(pairs.select("a", "b").distinct(), words, scorer, threshold, bound))
    return pairs.join(broadcast_if_small(scores, 40), ["a", "b"]).select("session_id", "i", "j", "score")


def _by_wording(words: DataFrame, placed: DataFrame, scorer: Scorer, threshold: float, bound: Scorer | None, index: tuple | None) -> DataFrame:
    """As similar_pairs, where there are fewer pairs of wordings than sessions have pairs of groups: wordings are scored as if they were one session, however many sessions have them.

    Groups then meet those of their session whose wording is known to be similar; no other pair is written or sent.
    """
    ids = words.select(F.lit(0).alias("session_id"), F.col("w").alias("idx"), "w")
    alone = words.select(F.col("w").alias("a"), F.col("w").alias("b"))
    scores = cut(scored_pairs(candidate_pairs(ids, words, threshold, index).select("a", "b").union(alone).distinct(), words, scorer, threshold, bound))
    sizes = placed.groupBy("session_id").count().agg(F.max("count")).first()[0]
    if sizes <= SMALL and scores.count() * 40 <= BROADCAST_BYTES:
        return _all_of_small(placed).join(F.broadcast(scores), ["a", "b"]).select("session_id", "i", "j", "score")
    one = placed.select("session_id", F.col("idx").alias("p"), F.col("w").alias("a")).join(broadcast_if_small(scores, 40), "a")
    two = placed.select("session_id", F.col("idx").alias("q"), F.col("w").alias("b"))
    both = one.join(two, ["session_id", "b"]).filter((F.col("p") < F.col("q")) | ((F.col("a") != F.col("b")) & (F.col("p") > F.col("q"))))
    return both.select("session_id", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "score")


def tfidf_pairs(groups: DataFrame, threshold: float = 0.8) -> DataFrame:
    """H1: session_id, i, j and score of groups of a session whose tf-idf vectors have a cosine at or above the threshold (above 0).

    A scorer with statistics of the session: a token's weight is its count times ln((1 + groups) / (1 + groups that have it)) + 1, and vectors have length 1. With tokens
    rarest first, a pair's first common token stands where the rest of either vector is still as long as the threshold, so pairs meet on those tokens only: in
    sessions of up to SMALL groups where they lie, in larger ones by a join on the token.
    """
    words = F.array_remove(F.split(F.trim(F.lower("canonical_text")), r"\s+", -1), "")
    # groups are dealt out by session once, which holds for all windows, groups and the meeting of small sessions
    dealt = groups.select("session_id", "idx", words.alias("words")).repartition("session_id")
    session, word = Window.partitionBy("session_id"), Window.partitionBy("session_id", "t")
    counts = dealt.withColumn("groups", F.count(F.lit(1)).over(session)).select("session_id", "idx", "groups", "words", F.explode(F.array_distinct("words")).alias("t"))
    counts = counts.select("session_id", "idx", "groups", "t", F.size(F.filter("words", lambda x: x == F.col("t"))).alias("tf")).withColumn("df", F.count(F.lit(1)).over(word))
    weight = F.col("tf") * (F.log((1 + F.col("groups")) / (1 + F.col("df"))) + 1)
    entry = F.struct("df", "t", weight.alias("w"))
    whole = counts.groupBy("session_id", "idx").agg(F.first("groups").alias("groups"), F.sort_array(F.collect_list(entry)).alias("v"))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    unit = whole.withColumn("long", F.sqrt(square(F.col("v"))))
    unit = unit.select("session_id", "idx", "groups", F.transform("v", lambda x: F.struct(x["df"].alias("df"), x["t"].alias("t"), (x["w"] / F.col("long")).alias("w"))).alias("v"))
    rest = lambda i: square(F.slice("v", i + 1, F.size("v")))
    early = F.filter(F.transform("v", lambda x, i: F.struct(x["t"].alias("t"), rest(i).alias("rest"))), lambda x: x["rest"] >= threshold * threshold - 1e-9)
    unit = unit.select("session_id", "idx", "groups", F.transform(early, lambda x: x["t"]).alias("heads"), F.map_from_entries(F.transform("v", lambda x: F.struct(x["t"], x["w"]))).alias("m"))
    i, j = (unit.select("session_id", F.col("idx").alias(at), F.col("heads").alias(f"heads_{at}"), F.col("m").alias(m), "groups") for at, m in (("i", "x"), ("j", "y")))
    both = i.filter(F.col("groups") <= SMALL).drop("groups").join(j.filter(F.col("groups") <= SMALL).drop("groups").hint("merge"), "session_id").filter((F.col("i") < F.col("j")) & F.arrays_overlap("heads_i", "heads_j"))
    both = both.select("session_id", "i", "j", "x", "y")
    if groups.groupBy("session_id").count().filter(F.col("count") > SMALL).limit(1).count():
        large = cut(unit.filter(F.col("groups") > SMALL).drop("groups"))
        heads = large.select("session_id", "idx", F.explode("heads").alias("t"))
        met = heads.withColumnRenamed("idx", "i").join(heads.withColumnRenamed("idx", "j"), ["session_id", "t"]).filter("i < j").select("session_id", "i", "j").distinct()
        with_x = met.join(large.select("session_id", F.col("idx").alias("i"), F.col("m").alias("x")), ["session_id", "i"])
        both = both.unionByName(with_x.join(large.select("session_id", F.col("idx").alias("j"), F.col("m").alias("y")), ["session_id", "j"]))
    score = F.aggregate(F.map_entries("x"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("y", e["key"]), F.lit(0.0)))
    return both.select("session_id", "i", "j", score.alias("score")).filter(F.col("score") >= threshold)


def scores_in_order(groups: DataFrame, scorer: Scorer = token_set) -> DataFrame:
    """H2: session_id, i, j and score of groups that follow each other in their session."""
    words, placed = _numbered(groups)
    before = Window.partitionBy("session_id").orderBy("idx")
    pairs = placed.select("session_id", F.col("idx").alias("j"), F.lag("idx").over(before).alias("i"), F.lag("w").over(before).alias("v"), "w").filter("i is not null")
    pairs = cut(pairs.select("session_id", "i", "j", F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")))
    scores = cut(scored_pairs(pairs.select("a", "b").distinct(), words, scorer, 0.0))
    return pairs.join(broadcast_if_small(scores, 40), ["a", "b"]).select("session_id", "i", "j", "score")


#: Links of a session up to which its clusters are found in one row; beyond it range by range.
FOLDED = 5_000


def greedy_clusters(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """H4, H6: session_id, idx, seed and confidence for every group.

    In order of idx an unassigned group seeds a cluster and takes the unassigned groups linked to it: a group is a seed unless a seed is among its lower
    neighbours, and goes to the lowest of those. A session of up to FOLDED links is one fold over its linked groups; how long its chains are makes no
    difference. The links of larger sessions are never held together.
    """
    edges = cut(edges.select("session_id", "i", "j", "score"))
    many = cut(edges.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FOLDED).select("session_id"))
    n = many.count()
    members = _folded(edges if not n else edges.join(many, "session_id", "left_anti"))
    if n:
        members = members.union(_in_ranges(edges.join(many, "session_id", "left_semi")))
    seeds = members.join(edges.select("session_id", F.col("i").alias("seed"), F.col("j").alias("idx"), "score"), ["session_id", "seed", "idx"])
    found = groups.select("session_id", "idx").join(seeds, ["session_id", "idx"], "left")
    return found.select("session_id", "idx", F.coalesce("seed", "idx").cast("int").alias("seed"), F.coalesce("score", F.lit(1.0)).alias("confidence"))


def _folded(edges: DataFrame) -> DataFrame:
    """session_id, idx and seed of the groups that join a cluster, by a fold over a session's linked groups in order."""
    lower = edges.groupBy("session_id", F.col("j").alias("idx")).agg(F.collect_list("i").alias("lower"))
    nodes = lower.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("idx", "lower"))).alias("nodes"))
    # a lower neighbour that hasn't joined a cluster is a seed
    joins = lambda have, x: F.when(F.size(F.array_except(x["lower"], have)) > 0, F.array_append(have, x["idx"])).otherwise(have)
    nodes = nodes.withColumn("joined", F.aggregate("nodes", F.array().cast("array<int>"), joins))
    each = nodes.select("session_id", "joined", F.explode("nodes").alias("x")).filter(F.array_contains("joined", F.col("x.idx")))
    return each.select("session_id", F.col("x.idx").alias("idx"), F.array_min(F.array_except("x.lower", "joined")).alias("seed"))


#: Places of a session that are settled at a time.
RANGE = 4096


def _in_ranges(edges: DataFrame) -> DataFrame:
    """As _folded, for sessions of any size. Places are settled in ranges, lower ones first, all sessions together; a range is a session's work for one task.

    Of what lies in earlier ranges a group needs the lowest seed that it is linked to, one number; so only links within a range are held together. As many jobs as
    there are ranges, however long the chains of links are; each range's outcome is written before the next one begins.
    """
    spark, kind = edges.sparkSession, edges.schema["session_id"].dataType.simpleString()
    folder = new_folder(spark, "ranges")
    ranged = edges.select("session_id", "i", "j", F.floor(F.col("i") / RANGE).alias("ri"), F.floor(F.col("j") / RANGE).alias("r"))
    ranged.write.partitionBy("r").parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("j")
        joined: dict[int, int] = {}
        for j, i, low in zip(*(table.column(c).to_pylist() for c in ("j", "i", "low")), strict=True):
            # a lower group that hasn't joined a cluster is a seed; low is one
            seed = low if i is None else None if i in joined else i
            if seed is not None:
                joined[j] = min(seed, joined.get(j, seed))
        return pa.table({"session_id": table.column("session_id").slice(0, 1).combine_chunks().take(pa.array([0] * len(joined), pa.int64())), "idx": pa.array(list(joined), pa.int32()), "seed": pa.array(list(joined.values()), pa.int32())})

    shape = f"session_id {kind}, idx int, seed int"
    for r in sorted(x.r for x in links.select("r").distinct().collect()):
        now = links.filter(F.col("r") == r)
        outer = now.filter(F.col("ri") < r)
        if files_of(spark, f"{folder}/joined"):
            gone = spark.read.schema(shape).parquet(f"{folder}/joined").select("session_id", F.col("idx").alias("i"))
            outer = outer.join(gone, ["session_id", "i"], "left_anti")
        low = outer.groupBy("session_id", "j").agg(F.min("i").alias("low")).select("session_id", "j", F.lit(None).cast("int").alias("i"), "low")
        inner = now.filter(F.col("ri") == r).select("session_id", "j", "i", F.lit(None).cast("int").alias("low"))
        inner.unionByName(low).groupBy("session_id").applyInArrow(settle, shape).write.mode("append").parquet(f"{folder}/joined")
    return spark.read.schema(shape).parquet(f"{folder}/joined")


#: Wordings up to which their scores are one table that every task has; no session has more groups than there are wordings.
TABLE = 2_048
#: Groups that a worker clusters at a time; a session is never parted.
TOGETHER = 40_000


def wordings(texts: DataFrame) -> DataFrame:
    """w and text: the distinct texts of the column `text`, nulls aside."""
    return cut(texts.select("text").filter("text is not null").distinct().withColumn("w", F.monotonically_increasing_id()))


def score_table(words: DataFrame, scorer: Scorer = token_set, threshold: float = 0.84, bound: Scorer | None = token_set_bound, index: tuple | None = TOKEN_SET_INDEX) -> dict[str, dict[str, float]] | None:
    """For each wording that has similar ones these and their scores; None if there are more than TABLE wordings or BROADCAST_BYTES of scores, which groups have to meet by joins."""
    if words.count() > TABLE:
        return None
    ids = words.select(F.lit(0).alias("session_id"), F.col("w").alias("idx"), "w")
    scores = cut(scored_pairs(candidate_pairs(ids, words, threshold, index).select("a", "b").distinct(), words, scorer, threshold, bound))
    if scores.count() * 40 > BROADCAST_BYTES:
        return None
    text = {r.w: r.text for r in words.collect()}  # TABLE rows at most
    table: dict[str, dict[str, float]] = {}
    for r in scores.collect():  # BROADCAST_BYTES at most
        for a, b in ((r.a, r.b), (r.b, r.a)):
            table.setdefault(text[a], {})[text[b]] = r.score
    return table


def seeds_of(places: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The seeds of sessions' groups. places: a row a session, the number of each group's wording in order, filled up with one that has no links; links: a matrix of wordings."""
    seeds = np.full(places.shape, -1, np.int32)
    for i in range(places.shape[1]):
        own = np.flatnonzero(seeds[:, i] < 0)
        seeds[own, i] = i
        later = seeds[own, i + 1 :]
        later[links[places[own, i, None], places[own, i + 1 :]] & (later < 0)] = i
        seeds[own, i + 1 :] = later
    return seeds


def clustered_by_table(groups: DataFrame, table: dict[str, dict[str, float]]) -> DataFrame:
    """Groups (session_id, content_hash, canonical_text, place and others, place last seen here) with idx, seed, confidence, cluster_id and cluster_size,
    as indexed, greedy_clusters and bank.in_clusters give them.

    Scores come from a score_table of all wordings, so no pair of groups is made, joined or sent: groups are dealt out by session once, and a task settles its sessions as
    they come in order, one place of many sessions at a time. Groups of a session differ in wording, so it has TABLE at most. Sessions without a key have no groups.
    """
    known = list(table)
    number = {text: i for i, text in enumerate(known)}
    scores = {(number[a], number[b]): score for a, near in table.items() for b, score in near.items()}
    names = [c for c in groups.columns if c != "place"]
    text_at, session_at = names.index("canonical_text"), names.index("session_id")
    shape = ", ".join(f"`{c}` {groups.schema[c].dataType.simpleString()}" for c in names) + ", idx int, seed int, confidence double, cluster_size int"

    def settled(rows: pa.Table, starts: np.ndarray, matrix: np.ndarray) -> pa.Table:
        coded = rows.column(text_at).combine_chunks().dictionary_encode()
        codes = np.array([number.get(t, len(known)) for t in coded.dictionary.to_pylist()] + [len(known)])
        word = codes[coded.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
        sizes = np.diff(np.append(starts, len(word)))
        idx = np.arange(len(word)) - np.repeat(starts, sizes)
        seed, linked = np.zeros(len(word), np.int32), matrix > 0
        width = 1
        while width // 2 < sizes.max():
            # sessions of like sizes, so that few places are filled up
            some = np.flatnonzero((sizes <= width) & (sizes > width // 2))
            there = np.arange(width) < sizes[some, None]
            at = (starts[some, None] + np.arange(width))[there]
            places = np.full(there.shape, len(known))
            places[there] = word[at]
            seed[at] = seeds_of(places, linked)[there]
            width *= 2
        head = np.repeat(starts, sizes) + seed
        confidence = np.where(seed == idx, 1.0, matrix[word[head], word])
        size = np.bincount(head, minlength=len(word))[head]
        for name, column in (("idx", idx.astype(np.int32)), ("seed", seed), ("confidence", confidence), ("cluster_size", size.astype(np.int32))):
            rows = rows.append_column(name, pa.array(column))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros((len(known) + 1, len(known) + 1))
        for (a, b), score in scores.items():
            matrix[a, b] = score
        held: list[pa.RecordBatch] = []
        ended = False
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            held += [] if ended else [batch]
            if not held or not ended and sum(map(len, held)) < TOGETHER:
                continue
            rows = pa.Table.from_batches(held)
            session = rows.column(session_at).combine_chunks()
            starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(session[1:], session[:-1]).to_numpy(zero_copy_only=False)])) if len(rows) else np.zeros(0, np.int64)
            # the last session may go on in the next batch
            end = len(rows) if ended or not len(starts) else int(starts[-1])
            if end:
                yield from settled(rows.slice(0, end), starts[starts < end], matrix).to_batches()
            held = rows.slice(end).to_batches()

    dealt = groups.filter("session_id is not null").repartition("session_id").sortWithinPartitions("session_id", "place", "content_hash")
    found = dealt.select(*names).mapInArrow(run, shape)
    return found.withColumn("cluster_id", F.concat_ws("_", F.lit("c"), F.col("session_id").cast("string"), F.col("seed").cast("string")))


def representatives(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """H5: session_id, seed, representative (the longest wording; the seed, then the earlier, among those as long) and size."""
    rows = clusters.join(groups.select("session_id", "idx", "canonical_text"), ["session_id", "idx"])
    rank = F.struct(F.length("canonical_text"), (F.col("idx") == F.col("seed")).alias("own"), (-F.col("idx")).alias("early"))
    return rows.groupBy("session_id", "seed").agg(F.max_by("idx", rank).alias("representative"), F.count(F.lit(1)).alias("cluster_size"))


def indexed(groups: DataFrame) -> DataFrame:
    """idx: the place of a group in its session, by where it was first asked."""
    order = Window.partitionBy("session_id").orderBy("place", "content_hash")
    return groups.withColumn("idx", F.row_number().over(order) - 1)
