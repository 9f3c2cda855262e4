"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 5).

Each document draws an exponential key scaled by its quality weight. Within a source, complete epochs take every document;
what is left of the source's target goes to the documents in ascending order of their keys, whose sizes are
summed up until the budget is reached. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import WORD, broadcast_if_small, cut, fresh

#: Documents of a source that are to share a cell of keys, about: the rows that one task sorts together.
CELL_ROWS = 20_000
#: Cells of a source at least.
LEAST_CELLS = 64


def quality_weight(text: Column) -> Column:
    """Default quality weight, above 0 and at most 1: it falls with the share of symbols among the words."""
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>!]"))
    return 1 / (1 + 5 * symbols / F.greatest(F.lit(1), F.regexp_count(text, F.lit(WORD))))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `target` to sources (source, source_size).

    Sources by code point, null last, get the weights in turn. Together they share `share` times all sizes by weight;
    a target stops at `most` times the source's size and the excess is shared again among the others. In
    ascending order of size by weight the sources that stop are the first ones, so the level at which the others end
    follows from sums over those before. The rows are as many as there are sources.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    rows = sources.withColumn("w", w).withColumn("stop", F.col("source_size") * most)
    order = Window.orderBy((F.col("stop") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.struct(F.col("stop") / F.col("w"), "level"))).over(whole)["level"]
    return rows.withColumn("level", level).select("source", "source_size", F.coalesce(F.least(F.col("stop"), F.col("level") * F.col("w")), F.col("stop")).alias("target"))


def _below(drawn: DataFrame) -> Column:
    """The share of draws that are expected below a draw, so that equal steps of it hold about as many rows each: a sum of exponential
    distributions, one for each range of quality, weighted by its rows."""
    level = F.round(F.log2("quality") * 2)
    ranges = drawn.groupBy(level.alias("level")).agg(F.avg("quality").alias("q"), F.count(F.lit(1)).alias("n")).collect()  # two for each power of 2 down to 1e-6
    whole, share = sum(r.n for r in ranges), F.lit(0.0)
    for r in sorted(ranges, key=lambda r: r.level):
        share = share + F.lit(r.n / whole) * (1 - F.exp(F.col("draw") * -r.q))
    return F.least(share, F.lit(1 - 1e-12))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    whole_documents: bool = False,
    seed: int = 17,
    quality: Column | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """One row for each input row: key, mark (hash of key and text), size, source_size, target, taken.

    docs: has the columns `key`, `text` and `source`; others are passed over. A document's size is its number of words (null text: 0). taken: words that the mix
    takes of it, repeats counted. The document at which the budget ends is taken in part, so that a source
    meets its target to a word; with whole_documents it is taken if at least half of it still fits.
    Null sources are one source; null keys draw like others; equal keys of the draw are ordered by key and text; rows that
    repeat key and text count each. Empty and null texts take nothing. An empty table gives an empty result.

    No source is sorted in one task: draws fall into cells of about CELL_ROWS documents or fewer, cells are summed up first, and each
    cell is then sorted by itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    weight = quality if quality is not None else quality_weight(text)
    sized = docs.select(F.col(key).alias("key"), F.col("source"), F.xxhash64(F.col(key), text).alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), weight.alias("quality"))
    # 52 bits, so that adding a half is exact and the draw lies strictly between 0 and 1
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mark"), 12) + 0.5) / float(1 << 52)
    sized = sized.withColumn("quality", F.greatest("quality", F.lit(1e-6)))
    drawn = cut(sized.select("key", "source", "mark", "size", "quality", (-F.log(u) / F.col("quality")).alias("draw")))
    per = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    n_sources, n_rows = per.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    targets = cut(source_targets(per.drop("n"), weights, share, most))
    celled = drawn.drop("quality").withColumn("cell", F.floor(_below(drawn) * max(LEAST_CELLS, -(-n_rows // CELL_ROWS))))
    cells = celled.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    by_cell = Window.partitionBy("source").orderBy("cell")
    cells = cells.select(F.col("source").alias("s"), F.col("cell").alias("c"), (F.sum("cell_size").over(by_cell) - F.col("cell_size")).alias("cells_before"))
    joined = celled.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    in_cell = Window.partitionBy("source", "cell").orderBy("draw", "key", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = joined.select("key", "source", "mark", "size", (F.col("cells_before") + F.sum("size").over(in_cell) - F.col("size")).alias("before"))
    targets = broadcast_if_small(targets.withColumnRenamed("source", "s"), 100, n_sources)
    found = summed.join(targets, F.col("source").eqNullSafe(F.col("s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    found = found.withColumn("epochs", epochs)
    left = F.round("target").cast("long") - F.col("epochs") * F.col("source_size") - F.col("before")
    if whole_documents:
        more = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0)
    else:
        more = F.greatest(F.lit(0), F.least(F.col("size"), left))
    taken = (F.col("epochs") * F.col("size") + more).cast("long")
    return found.select(F.col("key").alias(key), "mark", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """docs with each row as many times as the mix takes it whole; columns as they were, whatever their names.

    Rows that repeat key and text are each taken as often as the one of them that is taken most.
    """
    own, mark, n, copy = fresh(docs, "own_mark", "mix_mark", "mix_times", "mix_copy")
    plan = mix(docs, weights, share, most, whole_documents=True, seed=seed, key=key)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    plan = cut(plan.groupBy("mark").agg(F.max(times).alias(n)).filter(F.col(n) > 0).withColumnRenamed("mark", mark))
    marked = docs.withColumn(own, F.xxhash64(F.col(key), F.coalesce(F.col("text"), F.lit(""))))
    taken = marked.join(broadcast_if_small(plan, 20, plan.count()), F.col(own) == F.col(mark))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), n))).select(*docs.columns)
