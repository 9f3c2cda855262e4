"""Packing of documents into sequences by a linear grouping scheme (operator 11).

Lengths are whole numbers up to the capacity, so how many pieces have each length is all that a plan needs; it is a table of at most `capacity` rows, whatever the
corpus. Large lengths are cut into groups of about equal cardinality and rounded up to the largest of their group. A linear programme over the few sizes that are left, solved by column
generation, says how often to use each configuration of a sequence; what its rounding down leaves goes first-fit decreasing. Actual documents then take the places of
the rounded ones by their place in the group, which leaves gaps of their own; best-fit decreasing puts the small pieces into all gaps, again for whole classes of equal gaps and lengths at once.

A plan is a list of ranges of places. Pieces find their range by their place among the pieces of their length (`ranked`), so pieces are never gathered: a length that a third
of all pieces share is spread over tasks like any other.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import byte_letters, text_slices
from paperloom.llm.common import cut, resident, small_batches
from paperloom.llm.ranks import ranked

CAPACITY = 4096
#: A piece is large beyond this part of the capacity. With smaller parts more pieces are rounded up, and fewer are left that fit their gaps.
LARGE = 3
#: Sizes that large lengths are rounded up to.
SIZES = 96
#: Column generation stops after so many columns; the plan is whole at any time.
COLUMNS = 4_000
#: Words that a worker keeps; beyond it the table starts anew.
WORDS = 500_000

#: Bits of a sequence's number below its class.
NUMBER_BITS = 40

#: Words of printable characters below this one are split here, all others by the library: they are in normal form, and their lower case doesn't depend on what stands around them.
PLAIN_BELOW = "\u0180"
_PLAIN = [c for c in map(chr, range(33, ord(PLAIN_BELOW)))]
_LETTERS = re.escape("".join(c for c in _PLAIN if c.isalpha()))
_NUMBERS = re.escape("".join(c for c in _PLAIN if c.isnumeric() and not c.isalpha()))
# Fixed value: the word pattern of the vocabulary file.
UNITS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


class Words(dict[str, bytes]):
    """Ids (little-endian unsigned 32-bit) of words between white space, which the vocabulary drops. A word that isn't there yet is encoded by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.units: dict[str, bytes] = {}

    def unit(self, unit: str) -> bytes:
        if (ids := self.units.get(unit)) is None:
            letters = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.library.model.tokenize(letters)]).tobytes()
            self.units[unit] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and max(word) < PLAIN_BELOW:
            ids = b"".join([self.unit(u) for u in UNITS.findall(word.lower())]) if "İ" in word else self.unit(word.lower())
        elif word.isprintable() and max(word, default="") < PLAIN_BELOW and not any(s in word for s in self.special):
            ids = b"".join([self.unit(u) for u in UNITS.findall(word.lower())])
        else:
            ids = array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


def words(path: str) -> Words:
    return resident(("words", path), lambda: Words(path))


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """key, piece, start (ids of the document before it), length, ids of every piece of every document.

    path: of a tokenizers file of lower-case words that drops white space. A document is its text's ids and `end_id`; one of more than
    `capacity` ids is cut into pieces of `capacity`, of which the last may be shorter. Null and empty texts are the end id alone; null keys stay;
    rows that repeat a key are documents of their own; an empty table has no pieces; other columns are passed over, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    end, width = np.uint32(end_id).astype("<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(path)
        for rows, texts in text_slices(batches):
            if len(known) > WORDS:
                known.clear()
                known.units.clear()
            doc, number, ids = [], [], []
            for i, text in enumerate(texts):
                whole = known.encode(text) + end
                for k in range(0, len(whole), width):
                    doc.append(i)
                    number.append(k // width)
                    ids.append(whole[k : k + width])
            starts = [k * capacity for k in number]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["key", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col("text"))
    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids binary").withColumnRenamed("key", key)


def size_groups(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, int, int]]:
    """Shortest and longest length and number of pieces of each group, longest first; lengths below `least` have none. A length is never in two groups."""
    there = [n for n in np.flatnonzero(counts).tolist() if n >= least][::-1]
    total = int(counts[least:].sum())
    if len(there) <= groups:
        return [(n, n, int(counts[n])) for n in there]
    out: list[tuple[int, int, int]] = []
    held, top, done = 0, 0, 0
    for k, n in enumerate(there):
        top, held = top or n, held + int(counts[n])
        # an equal share of what is left to the groups that are left
        if held >= (total - done) / (groups - len(out)) or k == len(there) - 1:
            out.append((n, top, held))
            done, held, top = done + held, 0, 0
    return out


class Knapsack:
    """The best configuration for given values of the sizes, by dynamic programming over the room, a stretch as wide as the least size at a time."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        least = int(sizes.min())
        self.stretches = []
        for low in range(least, capacity + 1, least):
            room = np.arange(low, min(low + least, capacity + 1))
            # one place more in front stands for sizes that don't fit
            self.stretches.append((room, np.maximum(room[:, None] - sizes[None, :], -1) + 1))

    def best(self, values: np.ndarray) -> tuple[np.ndarray, float]:
        reach, taken = np.zeros(self.capacity + 2), np.full(self.capacity + 1, -1)
        reach[0] = -np.inf
        for room, at in self.stretches:
            options = reach[at] + values
            pick = options.argmax(axis=1)
            most = options[np.arange(len(room)), pick]
            better = most > 0
            reach[room + 1], taken[room] = np.where(better, most, 0), np.where(better, pick, -1)
        config, room = np.zeros(len(self.sizes), np.int64), self.capacity
        while taken[room] >= 0:
            config[taken[room]] += 1
            room -= int(self.sizes[taken[room]])
        return config, float(reach[-1])


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """How often to use which numbers of each size, so that the demand is met exactly with few sequences."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    used = demand / np.diag(basis)
    knapsack = Knapsack(sizes, capacity)
    for _ in range(COLUMNS):
        prices = np.linalg.solve(basis.T, np.ones(k))
        config, value = knapsack.best(prices)
        if value <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, config.astype(float))
        ratios = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        used = np.maximum(used - step * change, 0)
        used[out] = step
        basis[:, out] = config
    whole = np.floor(used + 1e-6).astype(np.int64)
    found = [(basis[:, j].round().astype(np.int64), int(whole[j])) for j in range(k) if whole[j]]
    rest = demand.astype(np.int64) - sum((c * n for c, n in found), np.zeros(k, np.int64))
    for j in np.flatnonzero(rest < 0).tolist():  # rounding of the last digit
        for i, (config, n) in enumerate(found):
            while rest[j] < 0 and config[j] and n:
                n, rest = n - 1, rest + config
            found[i] = (config, n)
    # what rounding down leaves: at most a few for each size
    while rest.any():
        config, room = np.zeros(k, np.int64), capacity
        for j in np.argsort(-sizes).tolist():
            config[j] = n = min(int(rest[j]), room // int(sizes[j]))
            room -= n * int(sizes[j])
        times = int((rest[config > 0] // config[config > 0]).min())
        rest -= config * times
        found.append((config, times))
    return [(c, n) for c, n in found if n]


def large_plan(counts: np.ndarray, capacity: int, least: int, sizes: int = SIZES) -> dict[str, np.ndarray]:
    """For each length its group and the pieces of the group before it; for each range of places in a group (key, ascending: group << NUMBER_BITS | place) the first bin and the slot."""
    groups = size_groups(counts, least, sizes)
    group_of, before = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for g, (low, high, _) in enumerate(groups):
        group_of[low : high + 1] = g
        upward = counts[low : high + 1]
        before[low : high + 1] = np.cumsum(upward) - upward
    plan = configurations(np.array([high for _, high, _ in groups]), np.array([n for *_, n in groups]), capacity)
    taken, ranges, bins = [0] * len(groups), [], 0
    for config, times in plan:
        slot = 0
        for g in np.flatnonzero(config).tolist():
            for _ in range(int(config[g])):
                ranges.append((g << NUMBER_BITS | taken[g], bins, slot))
                taken[g], slot = taken[g] + times, slot + 1
        bins += times
    rows = np.array(sorted(ranges), np.int64).reshape(-1, 3)
    return {"group": group_of, "before": before, "key": rows[:, 0], "bin": rows[:, 1], "slot": rows[:, 2]}


def small_plan(counts: np.ndarray, gaps: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing of small lengths into gaps, whole classes at once.

    counts: pieces of each length; gaps: bins of each gap. For each range of places of a length (key, ascending: length << NUMBER_BITS | place) how many pieces each bin
    takes, the first bin (its first gap and number there; gap capacity + 1 for new bins), and where in the bin they start.
    """
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    open_ = np.zeros(capacity + 1, bool)

    def put(gap: int, part: tuple[int, int, int]) -> None:
        held[gap].append(part)
        open_[gap] = True

    for gap in np.flatnonzero(gaps).tolist():
        put(gap, (gap, 0, int(gaps[gap])))
    rows, new = [], 0
    for size in np.flatnonzero(counts).tolist()[::-1]:
        left, place = int(counts[size]), 0
        while left:
            fits = open_[size:]
            at = int(fits.argmax())
            if fits[at]:
                gap = size + at
                own, low, high = held[gap].pop()
                open_[gap] = bool(held[gap])
            else:  # a bin more than can be filled whole; what isn't used is put down again below
                gap, own, low = capacity, capacity + 1, new
                high = new = new + -(-left // (capacity // size))
            # a bin is filled before the next: once begun, it is the tightest that fits
            each = min(gap // size, left)
            bins = min(high - low, left // each)
            rows.append((size << NUMBER_BITS | place, each, own, low, capacity - gap))
            put(gap - each * size, (own, low, low + bins))
            if low + bins < high:
                put(gap, (own, low + bins, high))
            left, place = left - bins * each, place + bins * each
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {n: columns[:, i] for i, n in enumerate(("key", "each", "own", "low", "used"))}


def _lengths(rows: DataFrame, column: str, capacity: int) -> np.ndarray:
    """How many rows have each length; at most capacity + 1 rows come to the driver."""
    out = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy(column).count().collect():
        out[length] = n
    return out


def pack(rows: DataFrame, order: list[str], capacity: int = CAPACITY, large: int = LARGE, sizes: int = SIZES) -> DataFrame:
    """rows (pieces with a column `length` from 1 to `capacity`) with sequence_id and offset: each sequence's pieces stand without gaps from offset 0.

    order: columns that tell pieces apart, so that reruns agree; pieces that are alike in all of them take each other's places. Other columns come along; rows may not
    have columns named sequence_id or offset. An empty table has no sequences. Lengths out of range are an error.
    """
    least = capacity // large + 1
    counts = _lengths(rows, "length", capacity)
    if counts[0]:
        raise ValueError("a piece without tokens")
    names = [f"c{i}" for i in range(len(rows.columns))]
    plain = rows.toDF(*names)
    length = names[rows.columns.index("length")]
    placed = ranked(plain, [length], [names[rows.columns.index(c)] for c in order], "place", "size")
    big = large_plan(counts, capacity, least, sizes)
    kinds = ", ".join(f"{c} {plain.schema[c].dataType.simpleString()}" for c in names)

    def columns_of(batch: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        return [batch.column(i) for i in range(len(names))], batch.column(names.index(length)).to_numpy(), batch.column(len(names)).to_numpy()

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n, place = columns_of(batch)
            key = big["group"][n] << NUMBER_BITS | big["before"][n] + place
            at = np.searchsorted(big["key"], key, "right") - 1
            yield pa.RecordBatch.from_arrays([*own, pa.array(big["bin"][at] + key - big["key"][at]), pa.array(big["slot"][at].astype(np.int32))], names=[*names, "bin", "slot"])

    seated = placed.filter(F.col(length) >= least).select(*names, "place").mapInArrow(seat, f"{kinds}, bin long, slot int")
    # fewer than `large` pieces a bin
    bins = seated.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("slot", *names))).alias("items"))
    bins = bins.withColumn("gap", F.lit(capacity) - F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x[length]))
    bins = cut(ranked(bins, ["gap"], ["bin"], "number", "alike"))
    before = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.aggregate(F.slice("items", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y[length]).alias("offset")))
    sequence = lambda own, number: F.shiftleft(own, NUMBER_BITS).bitwiseOR(number)
    first = bins.select(sequence(F.col("gap"), F.col("number")).alias("sequence_id"), F.explode(before).alias("x")).select(*[F.col(f"x.item.{c}").alias(c) for c in names], "sequence_id", "x.offset")
    little = small_plan(np.where(np.arange(capacity + 1) < least, counts, 0), _lengths(bins, "gap", capacity), capacity)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n, place = columns_of(batch)
            key = n << NUMBER_BITS | place
            at = np.searchsorted(little["key"], key, "right") - 1
            number, k = np.divmod(key - little["key"][at], little["each"][at])
            sequence_id = little["own"][at] << NUMBER_BITS | little["low"][at] + number
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence_id), pa.array(little["used"][at] + k * n)], names=[*names, "sequence_id", "offset"])

    rest = placed.filter(F.col(length) < least).select(*names, "place").mapInArrow(fill, f"{kinds}, sequence_id long, offset long")
    return first.unionByName(rest).toDF(*rows.columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary) and starts (offsets of its pieces) of packed pieces that have their ids; at most `capacity` ids come together."""
    items = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("items", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"]))
    return packed.groupBy("sequence_id").agg(items.alias("items")).select("sequence_id", joined.alias("ids"), F.transform("items", lambda x: x["offset"]).alias("starts"))
