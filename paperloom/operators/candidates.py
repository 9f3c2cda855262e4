"""Pairs of wordings that can be similar, by an inverted index (H3). Every pair at or above the threshold is among them; most others aren't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources.checkpoints import broadcast_if_small, cut

#: Rounding of bounds; it may let a pair in, never out.
SLACK = 1e-6

#: words (w, text) and a threshold to features; None where no feature is sure to be shared at that threshold.
Index = Callable[[DataFrame, float], DataFrame | None]


def tokens(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.trim(text), r"\s+", -1), ""))


def _rarest_first(rows: DataFrame, feature: str) -> DataFrame:
    """rows (w, the feature, c) with df, the number of wordings that have the feature."""
    df = cut(rows.groupBy(feature).agg(F.count(F.lit(1)).alias("df")))
    return rows.join(broadcast_if_small(df, 60), feature)


#: Longs of a signature.
SIGNS = 4


def _signature(features: Column) -> list[Column]:
    """Longs whose bits tell which of 64 * SIGNS residues the features have. Two of them differ in no more bits than one of the texts has features that the other lacks."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(63).cast("int"))
    of = lambda k: F.aggregate(F.filter(features, lambda x: x.bitwiseAND(SIGNS - 1) == k), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(bit(x)))
    return [of(k).alias(f"s{k}") for k in range(SIGNS)]


def token_set_features(words: DataFrame, threshold: float) -> DataFrame | None:
    """w, n, features (f, at, role) and signature (s0, s1, ...) of wordings for the token-set ratio.

    n is the length of the tokens joined by spaces. Two ways lead to the threshold, each with features of its own:

    * The shared tokens make up the text but for a part of (2 - 2t) / (2 - t) of n. Then one of its rarest tokens that are longer than this part together is shared:
      those have the role `part`, all tokens the role `whole`, and a pair has a `part` and a `whole` in common.
    * The sorted texts are alike letter by letter. Bigrams of tokens with a space at each end are the same whatever the order of the tokens. Deleting a letter costs
      two of them, putting one in costs one of the text before, so a text of length n alike to one of length m lacks 1.5 (1 - t)(n + m) - (m - n) / 2 of its n + 1
      bigrams at most. The rarest bigram that both have stands no later than that in the order of either: those have the role `both` and their place `at`. Many pairs have
      one in common by chance; signatures of the letters tell most of them apart, as each letter that one text has more often than the other is put in or deleted.
    """
    apart = 1 - threshold
    short, long = (1 - apart) / (1 + apart), (1 + apart) / (1 - apart) if apart < 1 else float("inf")
    most = max(1.5 * apart * (1 + m) - (m - 1) / 2 for m in (short, long))
    if not most < 1:
        return None
    split = cut(words.select("w", tokens(F.col("text")).alias("tok")).filter("size(tok) > 0").withColumn("n", F.aggregate("tok", F.lit(-1), lambda s, t: s + F.length(t) + 1)))
    each = _rarest_first(split.select("w", F.explode("tok").alias("t")), "t")
    ordered = each.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("by")).join(split.select("w", "n"), "w")
    free = F.col("n") * ((2 - 2 * threshold) / (2 - threshold)) + SLACK
    # a token is needed as long as those before it aren't longer than the part that may be missing
    before = lambda i: F.aggregate(F.slice("by", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x["t"]) + 1)
    key = lambda kind, *of: F.xxhash64(F.lit(kind), *of)
    word = F.transform("by", lambda x, i: F.struct(key("t", x["t"]).alias("f"), (before(i) <= free).alias("part")))
    by_word = ordered.select("w", "n", F.explode(word).alias("x")).select("w", "n", F.col("x.f").alias("f"), F.lit(-1).alias("at"), F.when(F.col("x.part"), "part").otherwise("whole").alias("role"))

    padded = F.transform("tok", lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    pairs = F.flatten(F.transform(padded, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, 2))))
    grams = split.select("w", F.explode(pairs).alias("g")).groupBy("w", "g").agg(F.count(F.lit(1)).cast("int").alias("c"))
    # of a bigram that a wording has c times the first, second, ... are features of their own
    counted = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("df", "g", "c"))), lambda x: F.transform(F.sequence(F.lit(1), x["c"]), lambda k: key("g", x["g"], k))))
    by_gram = _rarest_first(grams, "g").groupBy("w").agg(counted.alias("fs")).join(split.select("w", "n"), "w")
    kept = F.slice("fs", F.lit(1), F.floor(F.col("n") * most + SLACK).cast("int") + 1)
    # of a letter that a wording has c times the first, second, ... are features of their own
    letters = F.array_sort(F.split(F.array_join("tok", ""), ""))
    numbered = F.transform(letters, lambda x, i: key("l", x, i - F.array_position(letters, x)))
    by_gram = by_gram.join(split.select("w", *_signature(numbered)), "w")
    by_gram = by_gram.select("w", "n", *[f"s{k}" for k in range(SIGNS)], F.posexplode(kept).alias("at", "f")).withColumn("role", F.lit("both"))
    return by_word.unionByName(by_gram, allowMissingColumns=True)


def token_set_meets(one: Callable[[str], Column], two: Callable[[str], Column], threshold: float) -> Column:
    """Whether two wordings' common feature of the role `both` allows for the threshold."""
    n, m, apart = one("n"), two("n"), 1 - threshold
    near = F.abs(n - m) <= apart * (n + m) + SLACK
    early = lambda x, own, other: x("at") <= 1.5 * apart * (own + other) - (other - own) / 2 + SLACK
    differ = sum((F.bit_count(one(f"s{k}").bitwiseXOR(two(f"s{k}"))) for k in range(SIGNS)), F.lit(0))
    return near & early(one, n, m) & early(two, m, n) & (differ <= apart * (n + m) + SLACK)


def jaccard_features(words: DataFrame, threshold: float) -> DataFrame | None:
    """Features of wordings for the share of common tokens: of k tokens at least ceil(t k) are common, so one of the k - ceil(t k) + 1 rarest of each text is."""
    if threshold <= 0:
        return None
    split = words.select("w", tokens(F.col("text")).alias("tok")).filter("size(tok) > 0")
    each = _rarest_first(cut(split.select("w", F.size("tok").alias("n"), F.explode("tok").alias("t"))), "t")
    ordered = each.groupBy("w", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("by"))
    few = F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - SLACK).cast("int") + 1)
    return ordered.select("w", "n", F.posexplode(F.transform(few, lambda x: F.xxhash64(x["t"]))).alias("at", "f")).select("w", "n", "f", "at", F.lit("both").alias("role"))


def jaccard_meets(one: Callable[[str], Column], two: Callable[[str], Column], threshold: float) -> Column:
    n, m = one("n"), two("n")
    return F.least(n, m) >= threshold * F.greatest(n, m) - SLACK


def by_index(placed: DataFrame, features: DataFrame, meets: Callable[..., Column], threshold: float) -> DataFrame:
    """session_id, i, j, a, b: pairs of places (session_id, idx, w) of a session, i < j, whose wordings have features in common; each once."""
    rows = cut(placed.join(features, "w").withColumnRenamed("session_id", "s"))
    mine, other = rows.alias("mine"), rows.alias("other")
    one, two = (lambda side: lambda c: F.col(f"{side}.{c}"))("mine"), (lambda side: lambda c: F.col(f"{side}.{c}"))("other")
    both = (one("role") == "both") & (one("idx") < two("idx")) & meets(one, two, threshold)
    part = (one("role") == "part") & (one("idx") != two("idx"))
    same = (one("s") == two("s")) & (one("f") == two("f"))
    met = mine.join(other, same & (both | part))
    i, j = F.least(one("idx"), two("idx")), F.greatest(one("idx"), two("idx"))
    a, b = F.least(one("w"), two("w")), F.greatest(one("w"), two("w"))
    return met.select(one("s").alias("session_id"), i.alias("i"), j.alias("j"), a.alias("a"), b.alias("b")).distinct()
