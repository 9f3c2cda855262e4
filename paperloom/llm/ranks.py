"""Places of rows within their groups, whatever the groups' sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import broadcast_if_small, cut, fresh


def ranked(df: DataFrame, group: list[str], order: list[str], place: str, size: str) -> DataFrame:
    """df with `place` (from 0, in ascending order of `order`, nulls first) and `size` of each row's group (columns `group`; null is a group).

    Rows are dealt out by ranges of group and order together, so a group that holds a third of all rows is spread over many tasks. Within a task the
    places follow from the row's number there; what stands in earlier tasks is summed up from one row for each task and group, which are as
    many as there are tasks and groups together. Equal rows get places of their own, in any order.
    """
    part, at, first, before, n = fresh(df.select("*", F.lit(0).alias(place), F.lit(0).alias(size)), "part", "at", "first", "before", "n")
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()})
    # the bounds of the ranges are sampled, so what follows must read one and the same outcome
    dealt = cut(dealt)
    heads = dealt.groupBy(part, *group).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    whole = Window.partitionBy(*group)
    # without groups all heads are one: a row a task
    earlier = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = cut(heads.withColumns({before: F.coalesce(F.sum(n).over(earlier), F.lit(0)), size: F.sum(n).over(whole)}).drop(n))
    own = {c: f"{c}_{i}_{first}" for i, c in enumerate([part, *group])}
    heads = heads.withColumnsRenamed(own)
    same = reduce(lambda a, b: a & b, [dealt[c].eqNullSafe(heads[o]) for c, o in own.items()])
    joined = dealt.join(broadcast_if_small(heads, 100, heads.count()), same)
    return joined.withColumn(place, F.col(at) - F.col(first) + F.col(before)).select(*df.columns, place, size)
