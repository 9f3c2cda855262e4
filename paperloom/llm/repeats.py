"""Repeated passages by a depth-limited radix sort of suffixes (operator 7).

Suffixes are ordered by their first WINDOW bytes only, most significant digit first, and whoever is alone after a
pass drops out. Not every suffix goes through the passes by itself. The first digit of a window is its least
GRAM-byte string by hash, wherever it stands in the window, with its offset; consecutive windows with the same least
string are one segment and stay together until a pass tells them apart. The passes:

1. by the least string: segments whose string occurs once in the corpus drop out;
2. by the whole segment: of equal segments all but the first are repeats throughout;
3. by the whole window, for the segments that share their string with a different segment.

Groups that are equal after the last pass are exactly the repeated windows; the first of a group stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import text_slices
from paperloom.llm.common import broadcast_if_small, cut, mixed, own_folder, small_batches

WINDOW = 100
GRAM = 32
#: Bytes of text whose hashes a task holds at a time.
PIECE_BYTES = 500_000
#: Segments that a task holds before it sends them on; equal ones among them are sent once.
HELD = 300_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, for hashes of any range by differences of sums."""

    def __init__(self, base: int, n: int):
        inverse = pow(base, -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (base, inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the ranges start to end; equal ranges have equal hashes wherever they stand."""
        return mixed((sums[end] - sums[start]) * self.up[start] + (end - start).astype(np.uint64))


_POWERS: list[Powers] = []


def powers(n: int) -> list[Powers]:
    if not _POWERS or len(_POWERS[0].up) <= n:
        _POWERS[:] = [Powers(b, max(n, PIECE_BYTES + 300_000)) for b in _BASES]
    return _POWERS


def pieces(texts: list[bytes], window: int = WINDOW, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of texts strung together, about `most` at a time, and the runs in them: text number, offset of
    the run in its text, offset in the bytes, length. A longer text comes in runs that overlap by window - 1 bytes, so that each window is in one of them."""
    held: list[bytes] = []
    runs: list[tuple[int, int, int, int]] = []
    n = 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at >= window:
            part = text[at : at + most + window - 1]
            if n and n + len(part) > most:
                yield np.frombuffer(b"".join(held), np.uint8), *np.array(runs, np.int64).T
                held, runs, n = [], [], 0
            held.append(part)
            runs.append((i, at, n, len(part)))
            n += len(part)
            at += most
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), *np.array(runs, np.int64).T


def segments(data: np.ndarray, start: np.ndarray, length: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The segments of each run: run number, first window (offset in data), windows, gram hash, segment hash."""
    p, q = powers(len(data))
    sums = p.sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = p.hashes(sums, at, at + gram)
    width = window - gram + 1
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    n = len(order) - width + 1  # windows, those across runs included
    padded = np.full(-(-len(order) // width) * width, _MASK, np.uint64)
    padded[: len(order)] = order
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    run = np.full(len(data), -1, np.int32)
    for k, (s, size) in enumerate(zip(start.tolist(), length.tolist(), strict=True)):
        run[s : s + size - window + 1] = k
    run = run[:n]
    fresh = np.ones(n, bool)
    fresh[1:] = (least[1:] != least[:-1]) | (run[1:] != run[:-1])
    firsts = np.flatnonzero(fresh)
    counts = np.diff(np.append(firsts, n))
    inside = run[firsts] >= 0
    firsts, counts = firsts[inside], counts[inside]
    anchor = least[firsts]
    whole = q.hashes(q.sums(data), firsts, firsts + counts + window - 1) ^ mixed((anchor - firsts).astype(np.uint64))
    return run[firsts], firsts, counts, grams[anchor], whole


# A row of the passes: g (hash of the least string), sh (hash of the segment), key, pos.
# pos holds where the segment starts, 24 bits of the text's hash, and its number of windows.
_NULL_KEY = -(1 << 63)
_TH_BITS, _N_BITS = 24, 8
#: Kinds of rows: alone at its string in what the task held; a sign that a string has segments elsewhere; one of
#: several at its string; a repeat already found (sh: its end).
_ALONE, _SIGN, _KNOWN, _REPEAT = 0, 1, 2, 3
#: Different segments that share a string and are still compared in one task; beyond it their windows are dealt out one by one.
CROWD = 40_000
#: Windows that a task compares at a time, about.
WINDOWS_AT_ONCE = 800_000


def _pos(at: np.ndarray, th: np.ndarray, n: np.ndarray) -> np.ndarray:
    return at << (_TH_BITS + _N_BITS) | th << _N_BITS | n


def _at(pos: np.ndarray) -> np.ndarray:
    return pos >> (_TH_BITS + _N_BITS)


def _th(pos: np.ndarray) -> np.ndarray:
    return pos >> _N_BITS & ((1 << _TH_BITS) - 1)


def _n(pos: np.ndarray) -> np.ndarray:
    return pos & ((1 << _N_BITS) - 1)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in columns sorted together."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[0] = True
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _later(group: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows sorted by group, key and place: those that come after the first of their group. Rows at the same key and place are all first."""
    first = np.flatnonzero(group)[np.cumsum(group) - 1] if len(group) else np.zeros(0, np.int64)
    return (key != key[first]) | (at != at[first])


def merged_spans(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap, of the same owner (a number), as one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    own = _starts(owner)
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + (np.cumsum(own) - 1) * far) - (np.cumsum(own) - 1) * far
    fresh = own.copy()
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return owner[first], start[first], reach[np.append(first[1:], len(owner)) - 1]


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


_FIRST = "kind byte, g long, sh long, key long, pos long"


def _first_digits(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Segments of the texts (key, th, text). What a task finds equal among up to HELD segments is sent once."""
    names, limit = ["kind", "g", "sh", "key", "pos"], HELD

    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        g, sh, key, pos = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((pos, key, sh, g))
        g, sh, key, pos = g[order], sh[order], key[order], pos[order]
        later = _later(_starts(g, sh), key, _at(pos))
        # repeats by document, in as few spans as they make
        k, p = key[later], pos[later]
        docs_there, owner = np.unique(np.stack([k, _th(p)]), axis=1, return_inverse=True) if len(k) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        owner, start, end = merged_spans(owner.ravel(), _at(p), _at(p) + _n(p) + window - 1)
        yield _batch([np.full(len(owner), _REPEAT, np.int8), mixed(start.astype(np.uint64)).view(np.int64), end, docs_there[0][owner], _pos(start, docs_there[1][owner], np.zeros(len(owner), np.int64))], names)
        g, sh, key, pos = g[~later], sh[~later], key[~later], pos[~later]
        new_string, new_segment = _starts(g), _starts(g, sh)
        string = np.cumsum(new_string) - 1
        several = np.bincount(string, weights=new_segment)[string] > 1 if len(g) else np.zeros(0, bool)
        yield _batch([np.where(several, _KNOWN, _ALONE).astype(np.int8), g, sh, key, pos], names)
        signs = g[several & new_string]
        none = np.zeros(len(signs), np.int64)
        yield _batch([np.full(len(signs), _SIGN, np.int8), signs, none, none, none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for part, texts in text_slices(batches, 2_000_000):
            keys, ths = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for data, text, at, start, length in pieces([t.encode() for t in texts], window):
                run_no, first, count, g, sh = segments(data, start, length, window, gram)
                own = text[run_no]
                where = first - start[run_no] + at[run_no]
                held.append((g.view(np.int64), sh.view(np.int64), keys[own], _pos(where, ths[own], count)))
                n += len(g)
                if n >= limit:
                    yield from sent(held)
                    held, n = [], 0
        if n:
            yield from sent(held)

    return docs.mapInArrow(run, _FIRST)


def _second_digits(rows: DataFrame, window: int) -> DataFrame:
    """Rows that go on (kind _KNOWN) and repeats, from segments sorted by string and segment.

    A segment goes on if its string has other segments; of equal ones only the first does.
    """
    dealt = rows.repartition(F.expr(f"CASE WHEN kind IN ({_KNOWN}, {_REPEAT}) THEN sh ELSE g END"))
    dealt = dealt.sortWithinPartitions((F.col("kind") >= _KNOWN), (F.col("kind") == _REPEAT), "g", "sh", "key", "pos")
    names = ["kind", "g", "sh", "key", "pos"]

    def settled(kind: np.ndarray, g: np.ndarray, sh: np.ndarray, key: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups only."""
        found = kind == _REPEAT
        if found.any():
            yield _batch([c[found] for c in (kind, g, sh, key, pos)], names)
        several = np.isin(g, g[kind == _SIGN]) if (kind == _SIGN).any() else np.zeros(len(g), bool)
        mine = (kind == _ALONE) | (kind == _KNOWN)
        kind, g, sh, key, pos, several = (c[mine] for c in (kind, g, sh, key, pos, several))
        if not len(g):
            return
        low = kind < _KNOWN
        segment = _starts(low, g, sh)
        later = _later(segment, key, _at(pos))
        string = np.cumsum(_starts(low, g)) - 1
        several |= (kind == _KNOWN) | (np.bincount(string, weights=segment)[string] > 1)
        on = several & ~later
        yield _batch([np.full(int(on.sum()), _KNOWN, np.int8), g[on], sh[on], key[on], pos[on]], names)
        p = pos[later]
        yield _batch([np.full(len(p), _REPEAT, np.int8), g[later], _at(p) + _n(p) + window - 1, key[later], p], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if carry is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            kind, g, sh = cols[:3]
            # the last group may go on in the next batch
            if kind[-1] == _REPEAT:
                cut_at = len(kind)
            else:
                same = (g == g[-1]) & ((kind >= _KNOWN) == (kind[-1] >= _KNOWN)) & (kind != _REPEAT)
                if kind[-1] == _KNOWN:
                    same &= sh == sh[-1]
                cut_at = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            yield from settled(*(c[:cut_at] for c in cols))
            carry = [c[cut_at:] for c in cols]
        if carry is not None and len(carry[0]):
            yield from settled(*carry)

    return dealt.mapInArrow(run, _FIRST)


def _bytes_of(docs: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """g, key, pos and the bytes of each segment that goes on."""
    per = rows.groupBy("key", F.expr(f"(pos >> {_N_BITS}) & {(1 << _TH_BITS) - 1}").alias("th")).agg(F.collect_list(F.struct("g", "pos")).alias("own"))
    joined = docs.join(per, ["key", "th"]).select("key", "th", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            lists = part.column(3)
            flat = lists.flatten()
            g, pos = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            text_no = np.repeat(np.arange(len(texts)), counts)
            raw = [t.encode() for t in texts]
            starts, ends = _at(pos).tolist(), (_at(pos) + _n(pos) + window - 1).tolist()
            cut_out = [raw[i][a:b] for i, a, b in zip(text_no.tolist(), starts, ends, strict=True)]
            keys = part.column(0).to_numpy(zero_copy_only=False)[text_no]
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(keys), pa.array(pos), pa.array(cut_out, pa.binary())], names=["g", "key", "pos", "bytes"])

    return joined.mapInArrow(run, "g long, key long, pos long, bytes binary")


def _window_hashes(raw: list[bytes], pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the segments: segment number, offset in it, two hashes."""
    lengths = np.array([len(b) for b in raw], np.int64)
    begins = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(raw), np.uint8)
    p, q = powers(len(data))
    counts = _n(pos)
    seg = np.repeat(np.arange(len(raw)), counts)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begins[seg] + offset
    return seg, offset, p.hashes(p.sums(data), start, start + window).view(np.int64), q.hashes(q.sums(data), start, start + window).view(np.int64)


def _third_digits(rows: DataFrame, window: int) -> DataFrame:
    """Repeats (key, pos without windows, end) among the windows of segments that share a string."""
    crowded = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("g"))
    crowds = crowded.count()
    usual = rows if not crowds else rows.join(crowded, "g", "left_anti")
    dealt = usual.repartition("g").sortWithinPartitions("g")
    names, at_once = ["key", "pos", "end"], WINDOWS_AT_ONCE

    def spans(key: np.ndarray, pos: np.ndarray, seg: np.ndarray, offset: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
        owner, start, end = merged_spans(seg[later], offset[later], offset[later] + window)
        return _batch([key[owner], _pos(_at(pos[owner]) + start, _th(pos[owner]), np.zeros(len(owner), np.int64)), _at(pos[owner]) + end], names)

    def compared(g: np.ndarray, key: np.ndarray, pos: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        seg, offset, h, h2 = _window_hashes(raw, pos, window)
        k, at = key[seg], _at(pos)[seg] + offset
        order = np.lexsort((at, k, h2, h))
        later = np.zeros(len(seg), bool)
        later[order] = _later(_starts(h[order], h2[order]), k[order], at[order])
        return spans(key, pos, seg, offset, later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, key, pos, raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            g, key, pos = (np.concatenate([a, batch.column(i).to_numpy(zero_copy_only=False)]) for i, a in enumerate((g, key, pos)))
            raw += batch.column(3).to_pylist()
            if int(_n(pos).sum()) < at_once:
                continue
            n = int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            if n:
                yield compared(g[:n], key[:n], pos[:n], raw[:n])
                g, key, pos, raw = g[n:], key[n:], pos[n:], raw[n:]
        if len(g):
            yield compared(g, key, pos, raw)

    found = dealt.mapInArrow(run, "key long, pos long, end long")
    if not crowds:
        return found

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            seg, offset, h, h2 = _window_hashes(batch.column(3).to_pylist(), pos, window)
            yield _batch([h, h2, key[seg], _pos(_at(pos)[seg] + offset, _th(pos)[seg], np.zeros(len(seg), np.int64))], ["h", "h2", "key", "pos"])

    each = rows.join(F.broadcast(crowded), "g").mapInArrow(windows, "h long, h2 long, key long, pos long")
    first = each.groupBy("h", "h2").agg(F.min(F.struct("key", F.expr(f"pos >> {_TH_BITS + _N_BITS}").alias("at"))).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = each.join(first, ["h", "h2"]).filter(F.expr(f"NOT (key = first.key AND pos >> {_TH_BITS + _N_BITS} = first.at)"))
    return found.unionByName(again.select("key", "pos", F.expr(f"(pos >> {_TH_BITS + _N_BITS}) + {window}").alias("end")))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, th, spans (array of start and end, not yet merged) of texts (key, th, text) with different texts."""
    folder = own_folder(docs.sparkSession, "repeats") + "/second"
    second = _second_digits(_first_digits(docs, window, gram), window)
    second.select("kind", "g", F.when(F.col("kind") == _REPEAT, F.col("sh")).alias("end"), "key", "pos").write.parquet(folder)
    second = docs.sparkSession.read.parquet(folder)
    going = second.filter(F.col("kind") == _KNOWN).select("g", "key", "pos")
    third = _third_digits(_bytes_of(docs, going, window), window)
    repeats = second.filter(F.col("kind") == _REPEAT).select("key", "pos", "end").unionByName(third)
    place = F.expr(f"pos >> {_TH_BITS + _N_BITS}")
    th = F.expr(f"(pos >> {_N_BITS}) & {(1 << _TH_BITS) - 1}")
    return repeats.groupBy("key", th.alias("th")).agg(F.collect_list(F.struct(place.alias("start"), "end")).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each input row: key, n_bytes, spans (merged), kept (the bytes that remain).

    The key is a whole number above the least long, or null. A byte goes if a string of `window` bytes over it also starts earlier: at a smaller key, or at the same key and an earlier place. Strings are those of
    the input; they don't cross documents. Null and empty texts have no bytes. A null key comes before all others. Rows that repeat a key are judged
    each by itself against what starts earlier; the same place at the same key is not earlier, so equal rows keep what either keeps. An empty table
    gives an empty result; other columns are passed over. Whole copies of an earlier text are found first, by two 64-bit hashes, and go whole.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY)).alias("key"), text.alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(11), text).alias("h2"))
    copies = rows.filter(F.octet_length("text") >= window).groupBy("h", "h2").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = cut(copies.withColumnsRenamed({"h": "c", "h2": "c2"}))
    joined = rows.join(broadcast_if_small(copies, 24, copies.count()), (F.col("h") == F.col("c")) & (F.col("h2") == F.col("c2")), "left")
    copy = F.coalesce(F.col("key") != F.col("least"), F.lit(False))
    th = F.col("h").bitwiseAND(F.lit((1 << _TH_BITS) - 1)).alias("th")
    own = joined.filter(~copy).select("key", th, "text")
    spans = repeated_spans(own, window, gram)
    found = own.join(spans, ["key", "th"], "left").select("key", "th", "text", "spans")
    whole = joined.filter(copy).select("key", F.octet_length("text").cast("long").alias("n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            raw = [t.encode() for t in texts]
            lists = part.column(3)
            counts = np.nan_to_num(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            flat = lists.flatten()
            start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            owner, start, end = merged_spans(np.repeat(np.arange(len(raw)), counts), start, end)
            bounds = np.searchsorted(owner, np.arange(len(raw) + 1))
            out_spans, kept = [], []
            for i, t in enumerate(raw):
                mine = list(zip(start[bounds[i] : bounds[i + 1]].tolist(), end[bounds[i] : bounds[i + 1]].tolist(), strict=True))
                out_spans.append([{"start": a, "end": b} for a, b in mine])
                edges = [0, *(x for s in mine for x in s), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(out_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["key", "n_bytes", "spans", "kept"],
            )

    parts = found.mapInArrow(run, "key long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    gone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    all_rows = parts.unionByName(whole.select("key", "n_bytes", gone.alias("spans"), F.lit(b"").alias("kept")))
    return all_rows.select(F.when(F.col("key") != _NULL_KEY, F.col("key")).cast(kind).alias(key), "n_bytes", "spans", "kept")


def removal_digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 (lowercase hex) from remove_repeats."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return remove_repeats(docs, key).select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
