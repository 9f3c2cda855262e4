"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut

#: Edges up to which a round is one partition.
FEW = 50_000


def few(edges: DataFrame) -> DataFrame:
    """Up to FEW edges as one partition, so that a round takes no shuffle and writes one file, however many partitions shuffles have; more stay dealt out."""
    return edges.coalesce(1) if edges.count() <= FEW else edges


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of `edges` (columns u and v, long).

    Alternates large-star and small-star steps, each a minimum a node (combined in each task first) and
    a join, until the edges no longer change; each round is checkpointed, so its lineage stays short and
    a lost executor costs a round at most. No nulls; repeated edges and loops are harmless.
    """
    now = few(cut(_once(edges.select("u", "v"))))
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        now = few(cut(_small_star(_large_star(now))))
    links = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return links.union(links.select(F.col("component").alias("node"), "component")).distinct()


def _once(edges: DataFrame) -> DataFrame:
    """u < v, each pair once."""
    return edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour, itself included."""
    both = _each(edges, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return _once(edges.join(least, F.col("u") == F.col("w")).select(F.col("m").alias("u"), "v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("w"), "m")
    joined = edges.join(least, F.col("v") == F.col("w"))
    return _once(_each(joined, F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("w").alias("v"))))


def _each(rows: DataFrame, *edges: Column) -> DataFrame:
    """u and v of all the edges of each row, where the row lies: a union of two tables would deal out anew what is one partition."""
    return rows.select(F.explode(F.array(*edges)).alias("x")).select("x.u", "x.v")
