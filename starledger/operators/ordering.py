"""Ranks, running totals and neighbours in an order, for groups of any size.

A plain window sends a whole group to one task. Here rows are dealt by ranges of (group, order), so a group may span
many tasks: each range is summed on its own, and what came before it is added from one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Rows of a group that one task orders, when neighbours are needed.
BLOCK = 50_000


def running_totals(df: DataFrame, group: list[str], order: list[str], amount: str | Column, scratch: Scratch | None = None) -> DataFrame:
    """Add ``before`` (amount of the group's earlier rows) and ``total`` (amount of the group).

    ``order`` must be unique within a group; give enough columns. Nulls of ``amount`` count as 0; nulls of the
    order columns come first; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(df.sparkSession, "ordering")
    amount = F.col(amount) if isinstance(amount, str) else amount
    keys = [F.col(c) for c in [*group, *order]]
    ranged = df.withColumn("__amount", F.coalesce(amount, F.lit(0))).repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    # a range's number must not change between the two passes over it
    ranged = scratch.keep(ranged, f"ranges{len(scratch.paths)}")
    own = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.coalesce(F.sum("__amount").over(own), F.lit(0)))
    each = ranged.groupBy(*group, "__range").agg(F.sum("__amount").alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__range")  # a row for each range
    each = each.withColumn("__base", F.coalesce(F.sum("__sum").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = each.withColumn("total", F.sum("__sum").over(Window.partitionBy(*group))).drop("__sum")
    same = [local[c].eqNullSafe(each[c]) for c in [*group, "__range"]]
    out = local.join(each, same)
    return out.select(*[local[c] for c in df.columns], (F.col("__base") + F.col("__local")).alias("before"), "total")


def positions(df: DataFrame, group: list[str], order: list[str], scratch: Scratch | None = None) -> DataFrame:
    """Add ``position`` (from 0, in the group's order) and ``group_size``."""
    out = running_totals(df, group, order, F.lit(1).cast("long"), scratch)
    return out.withColumnsRenamed({"before": "position", "total": "group_size"})


def blocks(df: DataFrame, group: list[str], order: list[str], before: int = 0, after: int = 0, size: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Cut each group into blocks of ``size`` neighbours for windows over bounded frames.

    Adds position, group_size, ``block`` and ``context``: true for copies of the ``before`` rows ahead of a block and the
    ``after`` rows behind it, which its windows may read and which are dropped afterwards.
    """
    if max(before, after) > size:
        raise ValueError("a frame can't be longer than a block")
    placed = positions(df, group, order, scratch).withColumn("__b", F.floor(F.col("position") / size))
    last = F.floor((F.col("group_size") - 1) / size)
    inside = F.col("position") % size
    to = [F.struct(F.col("__b").alias("block"), F.lit(False).alias("context"))]
    if before:
        to.append(F.when((inside >= size - before) & (F.col("__b") < last), F.struct((F.col("__b") + 1).alias("block"), F.lit(True).alias("context"))))
    if after:
        to.append(F.when((inside < after) & (F.col("__b") > 0), F.struct((F.col("__b") - 1).alias("block"), F.lit(True).alias("context"))))
    spread = placed.withColumn("__to", F.explode(F.array_compact(F.array(*to))))
    return spread.select("*", "__to.block", "__to.context").drop("__to", "__b")


def neighbours(df: DataFrame, group: list[str], order: list[str], columns: dict[str, Column], before: int = 0, after: int = 0, size: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Add columns of window functions over ``over(window)`` placeholders: each value of ``columns`` is a function of a window."""
    cut = blocks(df, group, order, before, after, size, scratch)
    w = Window.partitionBy(*group, "block").orderBy("position")
    for name, make in columns.items():
        cut = cut.withColumn(name, make(w))
    return cut.where("not context").drop("block", "context")


def counted(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n): equal values together, which partial aggregation does before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, group: list[str], value: str, scratch: Scratch | None = None) -> DataFrame:
    """(group, value, n, rank, total): ranks from 1; ties share the mean of theirs."""
    out = running_totals(counted(df, group, value), group, [value], "n", scratch)
    return out.select(*group, value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), "total")


def order_statistics(df: DataFrame, group: list[str], value: str, wanted: dict[str, Column], scratch: Scratch | None = None) -> DataFrame:
    """For each group the mean of the values at given places.

    ``wanted`` maps a name to an array column of places (from 0) in terms of ``total``, the group's number of values;
    a place outside the group is ignored.
    """
    cumulated = running_totals(counted(df, group, value), group, [value], "n", scratch)
    aggs = []
    for name, places in wanted.items():
        held = F.filter(places, lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n")))
        hits = F.size(held)
        aggs.append((F.sum(F.col(value).cast("double") * hits) / F.sum(hits)).alias(name))
    return cumulated.groupBy(*group).agg(F.first("total").alias("total"), *aggs)


def middle(first: Column, count: Column) -> Column:
    """Places whose mean is the median of ``count`` values from place ``first`` on."""
    low, high = first + F.floor((count - 1) / 2), first + F.floor(count / 2)
    return F.array(low.cast("long"), high.cast("long"))


def median(df: DataFrame, group: list[str], value: str, scratch: Scratch | None = None) -> DataFrame:
    """(group, total, median), exact."""
    return order_statistics(df, group, value, {"median": middle(F.lit(0), F.col("total"))}, scratch)
