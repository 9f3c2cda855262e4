"""Quality classifier by importance resampling (operator 3).

Two generative models of hashed n-grams are compared: one of the target (texts labelled good), one of all raw text. A text's log weight
is its mean log ratio over its n-grams at a temperature, measured from a level that labelled texts held back set. Words that many texts labelled toxic share and target texts
lack count against it as well. Gumbel noise is added and the k largest stay: sampling without replacement in proportion to the weights. k is
the expected number of good texts, the sum of their odds w / (1 + w), so that texts near the level stay or go by the draw.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import text_slices
from paperloom.llm.common import cut, mixed, small_batches
from paperloom.llm.repeats import powers

#: Buckets of each kind of n-gram: words, word pairs, four bytes in a row.
BUCKETS = 1 << 15
KINDS = 3
#: Labelled texts that the target and the level are taken from, about; of more, every n-th by hash of the key.
MAX_LABELLED = 20_000
#: Pseudo-counts of a bucket in the target model.
SMOOTHING = 0.5
#: N-grams that a text is taken to have besides its own, with the mean ratio of a good text: short texts decide little.
PRIOR = 20.0
#: A difference in mean log ratio that makes one unit of log weight.
TEMPERATURE = 1 / 60
#: Words count as marks if this share of the texts labelled toxic have them, and that is so many times (as a log) their share among target texts.
MARK_SHARE, MARK_RATIO = 0.05, 2.0
#: Log weight that a mark takes away, for each unit of its log ratio.
MARK_WEIGHT = 1.5

_TARGET, _GOOD, _BAD, _TOXIC = 1, 2, 3, 4


def ngrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and buckets of all n-grams, for each kind. A word that follows itself makes one pair, whatever the word."""
    if not texts:
        return
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~blank
    start = np.flatnonzero(word & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(word & np.concatenate([blank[1:], [True]])) + 1
    p, _ = powers(len(data))
    words = p.hashes(p.sums(data), start, end)
    owner = np.searchsorted(ends, start, side="right")
    n = np.uint64(BUCKETS)
    yield owner, (words % n).astype(np.int64)
    if len(words) > 1:
        pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
        pairs[words[1:] == words[:-1]] = 0
        same = owner[1:] == owner[:-1]
        yield owner[1:][same], (pairs[same] % n).astype(np.int64) + BUCKETS
    if len(data) > 3:
        d = data.astype(np.uint64)
        four = mixed(d[:-3] | d[1:-2] << np.uint64(8) | d[2:-1] << np.uint64(16) | d[3:] << np.uint64(24))
        owner = np.repeat(np.arange(len(texts)), lengths)
        inside = owner[:-3] == owner[3:]  # a text's last bytes and the space after it, but not the next text
        yield owner[:-3][inside], (four[inside] % n).astype(np.int64) + 2 * BUCKETS


@dataclass
class Model:
    """Log ratio of each bucket, target to raw, and of marks, toxic to target (by bucket of words)."""

    ratios: np.ndarray
    centre: float = 0.0
    marks: np.ndarray | None = None

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean log ratio of each text, drawn to the centre by PRIOR n-grams, less its marks."""
        total, count, marked = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        for kind, (owner, bucket) in enumerate(ngrams(texts)):
            total += np.bincount(owner, self.ratios[bucket], len(texts))
            count += np.bincount(owner, minlength=len(texts))
            if kind == 0 and self.marks is not None:
                marked = np.bincount(owner, self.marks[bucket], len(texts))
        return (total + PRIOR * self.centre) / (count + PRIOR) - TEMPERATURE * MARK_WEIGHT * marked


def _roles(labels: DataFrame, key: str) -> DataFrame:
    """_key and role of a bounded sample of labelled texts: half of the good ones make the target and half of the toxic ones the marks; all others set the level."""
    usable = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull())
    step = max(1, -(-usable.count() // MAX_LABELLED))
    h = F.xxhash64(F.lit(3), key)
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) != 0 if "toxic" in labels.columns else F.lit(False)
    half = F.pmod(F.shiftright(h, 20), F.lit(2)) == 0
    role = F.when(toxic & half, _TOXIC).when(toxic | (F.col("quality") == 0), _BAD).when(half, _TARGET).otherwise(_GOOD)
    sample = usable.filter(F.pmod(h, F.lit(step)) == 0).select(F.col(key).alias("_key"), role.alias("role"))
    return sample.groupBy("_key").agg(F.min("role").alias("role"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part, texts in text_slices(batches, 1_000_000):
        yield part, [t.encode() for t in texts]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> tuple[Model, float]:
    """The model and the level. Raw counts are over all texts; the target and the level come from the labelled sample.

    Without labelled good texts every ratio is 0 and the level is below all scores, so that all texts stay.
    """
    small_batches(docs.sparkSession)
    roles = F.broadcast(cut(_roles(labels, key)))  # about MAX_LABELLED rows at most
    rows = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.join(roles, F.col("key") == F.col("_key"), "left").select("key", "role", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # raw and target n-grams, and texts of the target and toxic ones that have a word
        sums = {n: np.zeros(KINDS * BUCKETS, np.int64) for n in ("raw", "target", "target_texts", "toxic_texts")}
        of, some = {_TARGET: 0, _TOXIC: 0}, False
        for part, texts in _slices(batches):
            some = True
            role = part.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for r in of:
                of[r] += int((role == r).sum())
            for kind, (owner, bucket) in enumerate(ngrams(texts)):
                sums["raw"] += np.bincount(bucket, minlength=KINDS * BUCKETS)
                sums["target"] += np.bincount(bucket[role[owner] == _TARGET], minlength=KINDS * BUCKETS)
                if kind == 0:
                    for r, n in ((_TARGET, "target_texts"), (_TOXIC, "toxic_texts")):
                        mine = role[owner] == r
                        sums[n] += np.bincount(np.unique(owner[mine] * BUCKETS + bucket[mine]) % BUCKETS, minlength=KINDS * BUCKETS)
        if some:
            there = np.flatnonzero(sums["raw"])
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *[pa.array(x[there]) for x in sums.values()]], names=["bucket", *sums])
            numbers = [of[_TARGET], of[_TOXIC]]  # in a row of their own
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0]), pa.array([0]), *[pa.array([x]) for x in numbers]], names=["bucket", *sums])

    names = ["raw", "target", "target_texts", "toxic_texts"]
    counts = marked.mapInArrow(count, "bucket int, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    found = {n: np.zeros(KINDS * BUCKETS) for n in names}
    n_target = n_toxic = 0
    for r in counts.collect():  # KINDS * BUCKETS + 1 rows at most
        if r.bucket < 0:
            n_target, n_toxic = r.target_texts, r.toxic_texts
        else:
            for n in names:
                found[n][r.bucket] = r[n]
    model = fitted(*[found[n] for n in names], n_target, n_toxic)

    held = marked.filter(F.col("role").isin(_GOOD, _BAD)).mapInArrow(lambda batches: _scored(batches, model), "role int, score double")
    # a score that repeats, as that of a text with many rows, comes once, with the number of its rows; where keys repeat a sample by hash of 4 * MAX_LABELLED scores
    per = held.groupBy("role", "score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("role", "score")).limit(4 * MAX_LABELLED).collect()
    good, bad = ([(r.score, r.n) for r in per if (r.role == _GOOD) == g] for g in (True, False))
    if not good:
        return model, -np.inf
    model.centre = _median(good)
    return model, _level(good, bad)


def fitted(raw: np.ndarray, target: np.ndarray, target_texts: np.ndarray, toxic_texts: np.ndarray, n_target: int, n_toxic: int) -> Model:
    """The model from counts of n-grams by bucket, and of labelled texts that have a word."""
    raw, target = raw.reshape(KINDS, BUCKETS), target.reshape(KINDS, BUCKETS)
    p_raw = (raw + 1) / (raw.sum(axis=1, keepdims=True) + BUCKETS)
    p_target = (target + SMOOTHING) / (target.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    ratios = np.log(p_target / p_raw).ravel() if target.any() else np.zeros(KINDS * BUCKETS)
    share = (toxic_texts[:BUCKETS] + 0.5) / (n_toxic + 1)
    over = np.log(share / ((target_texts[:BUCKETS] + 0.5) / (n_target + 1)))
    is_mark = (toxic_texts[:BUCKETS] >= max(3, MARK_SHARE * n_toxic)) & (over > MARK_RATIO)
    return Model(ratios, marks=np.where(is_mark, over, 0.0))


def _median(counted: list[tuple[float, int]]) -> float:
    half, seen = sum(n for _, n in counted) / 2, 0
    for score, n in sorted(counted):
        seen += n
        if seen >= half:
            return score
    return 0.0


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for part, texts in _slices(batches):
        yield pa.RecordBatch.from_arrays([part.column(1), pa.array(model.scores(texts))], names=["role", "score"])


def _level(good: list[tuple[float, int]], bad: list[tuple[float, int]]) -> float:
    """Where most labelled texts (score and number) fall on their side, a lost good text counting as five bad ones kept; the middle of the best range."""
    if not bad:
        return min(good)[0] - 1.0
    cuts = np.unique([x for x, _ in [*good, *bad]])
    below = lambda rows: np.concatenate([[0], np.cumsum([n for _, n in sorted(rows)])])[np.searchsorted(sorted(x for x, _ in rows), cuts)] / sum(n for _, n in rows)
    cost = 5.0 * below(good) + 1 - below(bad)
    best = np.flatnonzero(cost == cost.min())
    return float(cuts[max(0, int(best[0]) - 1)] + cuts[int(best[-1])]) / 2


def _noisy(scores: np.ndarray, level: float, marks: np.ndarray) -> np.ndarray:
    """Log weights with Gumbel noise drawn by hash."""
    u = ((marks.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return (scores - level) / TEMPERATURE - np.log(-np.log(np.minimum(u, 1 - 2.0**-53)))


def weigh(docs: DataFrame, model: Model, level: float, key: str = "doc_id", seed: int = 5) -> DataFrame:
    """key, log_weight and draw (log weight with noise) for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            scores = model.scores(texts)
            marks = part.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array((scores - level) / TEMPERATURE), pa.array(_noisy(scores, level, marks))], names=["key", "log_weight", "draw"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.lit(seed), F.col(key), text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(run, f"key {kind}, log_weight double, draw double").withColumnRenamed("key", key)


def kth_largest(values: DataFrame, k: int, few: int = 10_000) -> float:
    """The k-th largest of column `draw`, by counting in ever narrower ranges; only counts and a few values reach the driver."""
    low, high = values.agg(F.min("draw"), F.max("draw")).first()
    while True:
        width = (high - low) / 1024
        inside = values.filter((F.col("draw") >= low) & (F.col("draw") <= high))
        if width <= 0 or low + width == low:
            return low
        cell = F.least(F.lit(1023), F.floor((F.col("draw") - low) / width))
        counts = sorted(((r.cell, r["n"], r.a, r.b) for r in inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("a"), F.max("draw").alias("b")).collect()), reverse=True)
        for _, n, a, b in counts:
            if n >= k:
                low, high = a, b
                break
            k -= n
        if n <= few:
            rows = values.filter((F.col("draw") >= low) & (F.col("draw") <= high)).select("draw").orderBy(F.desc("draw")).limit(k).collect()
            return rows[-1].draw


def select(docs: DataFrame, labels: DataFrame, key: str = "doc_id", seed: int = 5) -> DataFrame:
    """One row for each input row: key, log_weight, draw, kept.

    docs: has the columns `key` and `text`, labels: `key`, `quality` and perhaps `toxic` (a good text has quality 1 and is not toxic); others are passed
    over. Null and empty texts have the weight of a middling good text. Null keys draw by their text; rows that repeat key and text
    draw alike, and texts that tie for the last place all stay. Without labels all stay; an empty table gives an empty result.
    """
    model, level = fit(docs, labels, key)
    drawn = weigh(docs, model, level, key, seed)
    if level == -np.inf:
        return drawn.select(key, F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("draw"), F.lit(True).alias("kept"))
    drawn = cut(drawn)
    last = _last_draw(drawn)
    return drawn.withColumn("kept", F.col("draw") >= F.lit(last))


def _last_draw(drawn: DataFrame) -> float:
    """The k-th largest draw, where k is the expected number of good texts."""
    k = drawn.agg(F.round(F.sum(1 / (1 + F.exp(-F.col("log_weight")))))).first()[0]
    return kth_largest(drawn, int(k)) if k else float("inf")


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", seed: int = 5) -> DataFrame:
    """docs without the rows that select doesn't keep; columns as they were. Scores are made again where the rows are, so no text is shuffled."""
    model, level = fit(docs, labels, key)
    if level == -np.inf:
        return docs
    last = _last_draw(cut(weigh(docs, model, level, key, seed).select("log_weight", "draw")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            draws = _noisy(model.scores(texts), level, part.column(0).to_numpy(zero_copy_only=False))
            kept = part.filter(pa.array(draws >= last))
            yield pa.RecordBatch.from_arrays(kept.columns[1:-1], schema=pa.schema(list(kept.schema)[1:-1]))

    names = [f"_{i}" for i in range(len(docs.columns))]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(F.lit(seed), F.col(key), text).alias("mark"), *[F.col(c).alias(n) for c, n in zip(docs.columns, names)], text.alias("text"))
    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes))
    return rows.mapInArrow(run, schema).toDF(*docs.columns)
