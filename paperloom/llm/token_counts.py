"""Token counts under a unigram model by dynamic programming over a trie (operator 10).

The distinct pre-tokens of a task go into a trie. A node's forward score, the best sum of piece scores that
spells its path, follows from its ancestors' alone, so a prefix that many pre-tokens share is scored once. The number of
pieces on the best path is stored where a pre-token ends; a text's count is the sum over its pre-tokens. Piece scores are
log shares of the vocabulary's pieces in all texts, as its merges split them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import PieceCache, Vocabulary, text_slices
from paperloom.llm.common import resident, small_batches
from paperloom.llm.token_store import library_encoder

#: Nodes that a worker keeps; beyond it the trie starts anew.
MAX_NODES = 1_500_000


class Trie:
    """Forward scores of the prefixes of all pre-tokens inserted. Of paths with the best score the one with fewest pieces counts."""

    def __init__(self, scores: dict[bytes, float]):
        # every end of a piece, with the score if it is a piece itself: the search for the last piece goes back until no piece ends so
        self.ends: dict[bytes, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))}
        self.ends.update(scores)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.pieces: list[int] = [0]

    def count(self, word: bytes) -> int:
        """Pieces of the word on its best path; its new prefixes are scored on the way. Bytes that no piece covers make the count -1."""
        children, best, pieces, ends = self.children, self.best, self.pieces, self.ends
        path, node = [0], 0
        for d, byte in enumerate(word, 1):
            edge = node << 8 | byte
            if (child := children.get(edge)) is None:
                top, fewest = -math.inf, -1
                for a in range(d - 1, -1, -1):
                    s = ends.get(word[a:d], 0.0)
                    if s is None:
                        continue
                    if s == 0.0:  # no piece ends so; scores are below 0
                        break
                    before = path[a]
                    n = pieces[before] + 1
                    if n > 0:
                        total = best[before] + s
                        if total > top or (total == top and n <= fewest):
                            top, fewest = total, n
                child = children[edge] = len(best)
                best.append(top)
                pieces.append(fewest)
            node = child
            path.append(node)
        return pieces[node]


def _plain_pieces(path: str) -> tuple[dict[int, bytes], dict[str, int]]:
    """Pieces without the special tokens, and those."""
    v = Vocabulary(path)
    return {i: p for i, p in v.pieces.items() if i not in v.added.values()}, v.added


def fit_scores(docs: DataFrame, path: str) -> dict[bytes, float]:
    """Log shares of the vocabulary's pieces in all texts, as its merges split them; pieces are counted in each task first.

    Every piece counts once more than it occurs, so that none has a share of 0; without texts all shares are alike.
    """
    small_batches(docs.sparkSession)
    plain, _ = _plain_pieces(path)
    size = max(plain) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = library_encoder(path), np.zeros(size, np.int64)
        for _, texts in text_slices(batches):
            total += np.bincount(np.frombuffer(b"".join(own.of(texts)), "<u4"), minlength=size)[:size]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["piece", "n"])

    counts = docs.select("text").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    found = {r.piece: r.n for r in counts.collect()}  # a row for each piece of the vocabulary at most
    number = {p: i for i, p in sorted(plain.items(), reverse=True)}
    total = math.log(sum(found.get(i, 0) for i in number.values()) + len(number))
    return {p: math.log(found.get(i, 0) + 1) - total for p, i in number.items()}


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", scores: dict[bytes, float] | None = None) -> DataFrame:
    """key, n_pretokens and n_tokens (long) for each row, over whole texts.

    path: of a byte-level vocabulary file; its special tokens count as one each. scores: of its pieces, by default those that fit_scores finds on docs.
    Null and empty texts have none; null keys and repeated rows stay; an empty table gives an empty result; other columns are passed over. No texts are shuffled.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    scores = fit_scores(docs, path) if scores is None else scores
    name = ("counter", path, uuid.uuid4().hex)

    def make() -> PieceCache:
        trie = Trie(scores)

        def value(words: list[bytes]) -> list[bytes]:
            if len(trie.best) > MAX_NODES:
                trie.clear()
            return [trie.count(w).to_bytes(4, "little", signed=True) for w in words]

        return PieceCache(value, {s: (1).to_bytes(4, "little") for s in _plain_pieces(path)[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(name, make)
        for part, texts in text_slices(batches):
            values = [np.frombuffer(v, "<i4") for v in own.of(texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(v) for v in values], pa.int64()), pa.array([int(v.sum()) for v in values], pa.int64())], names=["key", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col("text"))
    return rows.mapInArrow(run, f"key {kind}, n_pretokens long, n_tokens long").withColumnRenamed("key", key)
