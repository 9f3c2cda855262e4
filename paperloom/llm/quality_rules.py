"""Quality rules as learned decision lists (operator 9).

Statistics of each text are Spark expressions. From labelled statistics, sequential covering grows a conjunction
of thresholds that picks bad texts, prunes it on rows held back, keeps it if it is precise there, and goes on with the
bad texts that it doesn't cover. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import BLANK, cut, fresh

#: Labelled rows that a list is learned from, about; of more, every n-th by hash of the key is taken.
MAX_LABELLED = 20_000

#: Fields of text_stats that are counts.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def text_stats(docs: DataFrame, key: str = "doc_id", window: int = 5) -> DataFrame:
    """key and COUNTS for each row; null text has no words and all counts 0.

    n_repeat_words counts words in windows that the text holds twice or more. Windows are compared by 64-bit hashes; only texts in which
    some hash repeats are sorted, so a text costs no more than n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        F.col(key).alias("key"),
        F.array_remove(F.split(text, BLANK, -1), "").alias("ws"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_marks"),
    )
    ws = F.col("ws")
    grams = F.when(F.size(ws) > window, F.transform(F.sequence(F.lit(0), F.size(ws) - window), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(window)])))
    second = first.select(
        "key",
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_upper",
        "n_marks",
        grams.alias("grams"),
    )
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    third = second.withColumn("ordered", F.when(repeats, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    o = F.col("ordered")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter(F.transform(o, lambda x, k: F.when(same(x, F.get(o, k - 1)) | same(x, F.get(o, k + 1)), x["i"])), lambda i: i.isNotNull())
    fourth = third.withColumn("at", F.sort_array(twice))
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))), F.lit(0), lambda s, x: s + x)
    return fourth.select(F.col("key").alias(key), *[F.coalesce(covered, F.lit(0)).cast("long").alias(c) if c == "n_repeat_words" else F.col(c) for c in COUNTS])


def features() -> dict[str, Column]:
    """What thresholds are set on, from the columns of text_stats."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_a_word": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "marks_a_word": F.col("n_marks") / words,
    }


@dataclass(frozen=True)
class Threshold:
    feature: str
    above: bool  # >= at, else <= at
    at: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] >= self.at if self.above else row[self.feature] <= self.at

    def column(self) -> Column:
        f = features()[self.feature]
        return f >= self.at if self.above else f <= self.at


@dataclass
class DecisionList:
    """Ordered conjunctions that reject; a text that none covers is kept."""

    rules: list[tuple[Threshold, ...]] = field(default_factory=list)

    def kept(self) -> Column:
        """The verdict as an ordered conditional expression over the columns of text_stats."""
        out = None
        for rule in self.rules:
            holds = F.lit(True)
            for t in rule:
                holds = holds & t.column()
            out = F.when(holds, False) if out is None else out.when(holds, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def keeps(self, row: dict[str, float]) -> bool:
        return not any(all(t.holds(row) for t in rule) for rule in self.rules)


def _best_threshold(x: np.ndarray, bad: np.ndarray, names: list[str], least: int) -> Threshold | None:
    """The threshold of most information gain among all of each feature that lie between two different values and cover at least `least` bad rows."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, Threshold | None] = (1e-9, None)
    for f, name in enumerate(names):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        cut = np.flatnonzero(v[1:] != v[:-1]) + 1
        if not len(cut):
            continue
        below_p = np.cumsum(b)[cut - 1]
        below_n = cut - below_p
        for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p >= least, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), Threshold(name, above, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
    return best[1]


def learn_list(rows: list[tuple[dict[str, float], bool]], precision: float = 0.97, max_rules: int = 12, max_terms: int = 3) -> DecisionList:
    """rows: features and whether the text is bad. Two thirds grow rules, one third prunes and accepts them.

    A rule grows by the threshold of most information gain, among all that the rows still covered leave, until it covers no good row; it loses final thresholds
    while that doesn't lower its worth on the pruning rows, and is accepted only if at least `precision` of what it
    covers in either part is bad. The bad rows of a rule that isn't are set aside, and growing goes on with the others. No labelled rows, or rows of one class
    only, give an empty list.
    """
    found = DecisionList()
    bad = np.array([b for _, b in rows], bool)
    if not bad.any() or bad.all():
        return found
    names = list(rows[0][0])
    x = np.array([[r[n] for n in names] for r, _ in rows], float)
    pruning = np.arange(len(rows)) % 3 == 0
    open_ = np.ones(len(rows), bool)  # neither covered by a rule nor set aside
    least = max(2, len(rows) // 1000)

    def covered(rule: tuple[Threshold, ...]) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for t in rule:
            v = x[:, names.index(t.feature)]
            out &= v >= t.at if t.above else v <= t.at
        return out

    def worth(rule: tuple[Threshold, ...]) -> float:
        hit = covered(rule) & open_ & pruning
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    for _ in range(2 * max_rules):
        if len(found.rules) == max_rules or (open_ & bad & ~pruning).sum() < least or not (open_ & bad & pruning).any():
            break
        rule: tuple[Threshold, ...] = ()
        here = open_ & ~pruning
        while len(rule) < max_terms and (here & ~bad).any():
            t = _best_threshold(x[here], bad[here], names, least)
            if t is None:
                break
            rule = (*rule, t)
            here &= covered((t,))
        if not rule:
            break
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = covered(rule) & open_
        parts = [((hit & part & bad).sum(), (hit & part).sum()) for part in (pruning, ~pruning)]
        if parts[0][0] and all(p >= precision * n for p, n in parts):
            found.rules.append(rule)
            open_ &= ~hit
        else:
            open_ &= ~(hit & bad)
    return found


def labelled_rows(stats: DataFrame, labels: DataFrame, key: str = "doc_id", most: int = MAX_LABELLED) -> list[tuple[dict[str, float], bool]]:
    """Features and badness (quality 0) of labelled texts: a sample by hash of the key of about `most`, or where keys repeat one by hash of the features of 2 * `most`."""
    step = max(1, -(-labels.count() // most))
    (own,) = fresh(stats, "label_key")
    taken = labels.filter(F.col("quality").isNotNull() & (F.pmod(F.xxhash64(key), F.lit(step)) == 0)).select(F.col(key).alias(own), (F.col("quality") == 0).alias("bad"))
    names = list(features())
    joined = stats.join(taken, F.col(key) == F.col(own)).select("bad", *[c.alias(n) for n, c in features().items()])
    sample = joined.orderBy(F.xxhash64(*names, "bad")).limit(2 * most).collect()
    return [({n: r[n] for n in names}, r["bad"]) for r in sorted(sample, key=lambda r: (*[r[n] for n in names], r["bad"]))]


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, COUNTS, base_failed and kept for each row.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. kept: false if base_failed, else the verdict of a
    list learned from the labelled texts among docs. Null text counts as empty and fails; null and repeated
    keys stay; without labels every text that passes the base is kept; other columns are passed over.
    """
    stats = cut(text_stats(docs, key))
    verdict = learn_list(labelled_rows(stats, labels, key)).kept()
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)
