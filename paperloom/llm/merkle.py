"""Merkle manifest of a table by time-forward processing (operator 12).

The leaves of a group are the digests of its rows in order of the key; every two consecutive nodes have a parent. The groups' roots
are the leaves of one more tree. A tree is cut into blocks of 2^LEVELS consecutive nodes; tier by tier the blocks' roots become
the nodes of the next tier, until a group has one. Within a block the nodes are labelled level by level, and digests travel as messages of a
priority queue that is ordered by the label of the receiver: a node takes its children's digests off the queue and sends its own to its parent. The
reversed sweep goes through the labels the other way, from the tiers' top down: a node takes the proof suffix that holds from it to the root and
sends each child that suffix with the child's sibling in front.

Only digests are shuffled, never the rows. A block is a bounded piece of work, and each tier is checkpointed, so a lost executor costs blocks.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut, small_batches
from paperloom.llm.ranks import ranked

#: Levels of a tree that one block spans.
LEVELS = 9
#: Messages that a queue holds in memory; beyond it they are sorted onto disk.
HELD = 50_000

#: A step of a proof: where the sibling stands, then its digest. A node without sibling has a step of its own.
LEFT, RIGHT, ALONE = "<", ">", "="


class Queue:
    """A priority queue of messages (label first) that keeps sorted runs on the worker's disk beyond `held` messages."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.fronts = held, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            run = self._run(sorted(self.heap))
            self.heap = []
            heapq.heappush(self.fronts, (next(run), id(run), run))

    @staticmethod
    def _run(messages: list[tuple]) -> Iterator[tuple]:
        """The messages once more, read from a file that nothing else sees and that goes with its last message."""
        with tempfile.TemporaryFile() as f:
            for message in messages:
                pickle.dump(message, f)
            n = len(messages)
            messages.clear()
            f.seek(0)
            for _ in range(n):
                yield pickle.load(f)

    def __bool__(self) -> bool:
        return bool(self.heap or self.fronts)

    def least(self) -> tuple:
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0]):
            return self.fronts[0][0]
        return self.heap[0]

    def pop(self) -> tuple:
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0]):
            message, key, run = heapq.heappop(self.fronts)
            if (after := next(run, None)) is not None:
                heapq.heappush(self.fronts, (after, key, run))
            return message
        return heapq.heappop(self.heap)


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


#: A label has the level above these bits and the place on its level below.
PLACE_BITS = 48


def forward(digests: list[str], levels: int, held: int = HELD) -> tuple[str, list[tuple[int, list[str]]]]:
    """The root of a block's nodes, `levels` above them, and what each node above them has received, in order of the labels."""
    queue, log = Queue(held), []
    if not levels:
        return digests[0], log
    for i, digest in enumerate(digests):
        queue.push((1 << PLACE_BITS | i >> 1, i, digest))
    while queue:
        label = queue.least()[0]
        got = []
        while queue and queue.least()[0] == label:
            got.append(queue.pop()[2])
        log.append((label, got))
        level, i = label >> PLACE_BITS, label & (1 << PLACE_BITS) - 1
        if level < levels:
            queue.push((level + 1 << PLACE_BITS | i >> 1, i, joined(got)))
    return joined(log[-1][1]), log


def backward(n: int, log: list[tuple[int, list[str]]], above: list[str], held: int = HELD) -> list[list[str]]:
    """The proof of each of a block's n nodes; above: that of the block's root. The labels are gone through from the last to the first."""
    proofs: list[list[str]] = [above] * n
    if not log:
        return proofs
    queue = Queue(held)
    queue.push((-log[-1][0], above))
    for label, got in reversed(log):
        suffix = queue.pop()[1]
        level, i = label >> PLACE_BITS, label & (1 << PLACE_BITS) - 1
        steps = [ALONE] if len(got) == 1 else [RIGHT + got[1], LEFT + got[0]]
        for k, step in enumerate(steps):
            child, proof = 2 * i + k, [step, *suffix]
            if level == 1:
                proofs[child] = proof
            else:
                queue.push((-(level - 1 << PLACE_BITS | child), proof))
    return proofs


def _levels(n: int, most: int) -> int:
    """Levels from n nodes to one, up to `most`."""
    return min(most, (n - 1).bit_length())


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _blocked(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", most))


def _climbed(nodes: DataFrame, kind: str, most: int) -> DataFrame:
    """The next tier: grp, place, n, digest of the blocks' roots."""

    def climb(table: pa.Table) -> pa.Table:
        table, n = _sorted(table), table.column("n")[0].as_py()
        root, _ = forward(table.column("digest").to_pylist(), _levels(n, most))
        return pa.table({"grp": table.column("grp").slice(0, 1), "place": table.column("block").slice(0, 1), "n": pa.array([-(-n >> most)], pa.int64()), "digest": pa.array([root])})

    nodes = _blocked(nodes.select("grp", "place", "n", "digest"), most)
    return nodes.groupBy("grp", "block").applyInArrow(climb, f"grp {kind}, place long, n long, digest string")


def _descended(nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """nodes (without n) with the proof and the apex (digests from the group's root up) of each, from those of the tier above: each block meets its root's."""
    names = [c for c in nodes.columns if c != "n"]
    strings = pa.list_(pa.string())

    def descend(own: pa.Table, upper: pa.Table) -> pa.Table:
        own = _sorted(own)
        _, log = forward(own.column("digest").to_pylist(), _levels(own.column("n")[0].as_py(), most))
        proofs = backward(own.num_rows, log, upper.column("proof")[0].as_py())
        apex = [upper.column("apex")[0].as_py()] * own.num_rows
        return own.select(names).append_column("proof", pa.array(proofs, strings)).append_column("apex", pa.array(apex, strings))

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in names)
    upper = above.select("grp", F.col("place").alias("block"), "proof", "apex")
    return _blocked(nodes, most).groupBy("grp", "block").cogroup(upper.groupBy("grp", "block")).applyInArrow(descend, f"{kinds}, proof array<string>, apex array<string>")


def _tiers(nodes: DataFrame, kind: str, most: int) -> list[DataFrame]:
    """The tiers of all groups' trees, from their leaves (grp, place, n, digest) to one node a group."""
    tiers, n = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while n > 1:
        tiers.append(cut(_climbed(tiers[-1], kind, most)))
        n = -(-n >> most)
    return tiers


def _down(tiers: list[DataFrame], tops: DataFrame, most: int) -> DataFrame:
    """The leaves with their proof and apex; tops: the same of the one node that each group has at last. The leaves' own proofs, which are long, are neither kept nor shuffled."""
    for nodes in reversed(tiers[1:-1]):
        tops = cut(_descended(nodes, tops, most))
    return _descended(tiers[0], tops, most)


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row: of each column `-` if null, else its UTF-8 byte count, a colon and the value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", key: str = "doc_id", claims: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row for each input row: key, group, place (in its group), leaf, proof, subroot (of its group) and root.

    A leaf is the digest of a row's `columns`. Per group the leaves stand by ascending key; the groups stand by ascending value, null first, text bytewise; a group
    of one leaf has that leaf as its subroot. proof: the steps from the leaf through its subroot to the root, each `<` or `>` (the sibling stands left or right)
    and the sibling's digest, or `=` where a node has none; see `folded`. claims: further digests by name that are made where the rows are read and come along.

    Null values are leaves' values of their own; null keys come first, and a null group is a group. Rows that repeat key and group stand in the order of their leaves; rows that
    repeat everything are leaves of their own beside each other. An empty table has no leaves. Other columns are passed over, whatever their names. Long texts are hashed where they are.
    """
    small_batches(docs.sparkSession)
    claims = claims or {}
    renamed = {c: f"claim_{i}" for i, c in enumerate(claims)}
    kind = docs.schema[group].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(group).alias("grp"), leaf_digest([F.col(c) for c in columns]).alias("digest"), *[digest.alias(renamed[c]) for c, digest in claims.items()])
    tiers = _tiers(cut(ranked(rows, ["grp"], ["id", "digest"], "place", "n")), kind, levels)
    # the groups' roots are the leaves of one more tree
    subroots = tiers[-1].select(F.col("grp").alias("of"), "digest")
    tops = _tiers(cut(ranked(subroots, [], ["of"], "place", "n").withColumn("grp", F.lit(0))), "int", levels)
    top = tops[-1].select("grp", "place", F.array().cast("array<string>").alias("proof"), F.array("digest").alias("apex"))
    starts = _down(tops, top, levels).select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("place"), "proof", F.array_prepend("apex", F.col("digest")).alias("apex"))
    found = _down(tiers, cut(starts), levels)
    named = [F.col(r).alias(c) for c, r in renamed.items()]
    return found.select(F.col("id").alias(key), F.col("grp").alias(group), "place", F.col("digest").alias("leaf"), *named, "proof", F.get("apex", F.lit(0)).alias("subroot"), F.get("apex", F.lit(1)).alias("root"))


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""

    def step(have: Column, x: Column) -> Column:
        side, sibling = F.substring(x, 1, 1), F.substring(x, 2, 64)
        return F.sha2(F.when(side == LEFT, F.concat(sibling, have)).otherwise(F.concat(have, sibling)), 256)

    return F.aggregate(proof, digest, step)


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, strung together."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.substring(x, 2, 64)), ""), 256)
