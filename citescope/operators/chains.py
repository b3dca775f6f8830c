"""Chains inside groups of any size: which rows does a rule reach that jumps from one row to the next.

A chain (run, skip everything within the width, run again, ...) is sequential within its group, so the plain form folds a
group in one task. Here every point gets its successor by windows over slices of time, and the chain is found by
doubling: pointers that leave a stretch of time are composed to pointers that leave a stretch twice as long, level by
level, and the chain is read off from the longest stretch down. All joins are on (group, time), so a group spreads over
all tasks; a level keeps only points that a stretch can be entered by, so the levels together are about twice the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored


def successors(points: DataFrame, width: int, unit: int) -> DataFrame:
    """(key, us, nxt): `nxt` is the key's first point later than us + width, NULL if there is none.

    `points` has one row per (key, us). Points and searched times meet in slices of `unit` microseconds; what a slice
    lacks comes from one row per later slice.
    """
    seen = points.select("key", F.col("us").alias("at"), F.lit(None).cast("bigint").alias("us"))
    asked = points.select("key", (F.col("us") + width).alias("at"), "us")
    both = seen.unionByName(asked).withColumn("_cell", F.struct("key", F.floor(F.col("at") / unit).alias("slice")))
    point = F.when(F.col("us").isNull(), F.col("at"))
    # Latest first, and at one time what is searched before the points: a row then has exactly the later points behind it.
    downwards = Window.partitionBy("_cell").orderBy(F.desc("at"), F.col("us").isNull())
    looked = both.withColumn("_nxt", F.min(point).over(downwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cells = looked.groupBy("_cell").agg(F.min(point).alias("_first"))
    beyond = Window.partitionBy("_cell.key").orderBy(F.desc("_cell.slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("_cell", F.min("_first").over(beyond).alias("_carry"))
    return looked.where(F.col("us").isNotNull()).join(carried, "_cell").select(
        "key", "us", F.coalesce("_nxt", "_carry").alias("nxt")
    )


def reached(points: DataFrame, starts: DataFrame, width: int, unit: int) -> DataFrame:
    """(key, us) of every point on the chain that starts at `starts` (key, us; at most one per key, each a point)."""
    low, high = points.agg(F.min("us"), F.max("us")).first()
    levels = 0 if low is None else ((high - low) // width).bit_length()

    def stretch(us: str, level: int) -> Column:
        return F.shiftright(F.floor((F.col(us) - low) / width).cast("bigint"), level)

    def inside(level: int) -> Column:
        """The successor stays in the point's stretch of 2**level widths."""
        return F.coalesce(stretch("us", level) == stretch("nxt", level), F.lit(False))

    tables = [stored(successors(points, width, unit))] if levels else []
    for level in range(1, levels):
        below = tables[-1]
        entered = below.where(F.col("nxt").isNotNull() & ~inside(level)).select("key", F.col("nxt").alias("us"))
        entries = entered.unionByName(starts.select("key", "us")).distinct()
        hop = below.select("key", F.col("us").alias("nxt"), F.col("nxt").alias("_then"))
        doubled = entries.join(below, ["key", "us"]).withColumn("_in", inside(level)).join(hop, ["key", "nxt"], "left")
        tables.append(stored(doubled.select("key", "us", F.when(F.col("_in"), F.col("_then")).otherwise(F.col("nxt")).alias("nxt"))))
    found = starts.select("key", "us")
    for level in range(levels, 0, -1):
        step = F.array_compact(F.array(F.col("us"), F.when(inside(level), F.col("nxt"))))
        found = found.join(tables[level - 1], ["key", "us"], "left").select("key", F.explode(step).alias("us"))
    return found
