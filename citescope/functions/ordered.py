"""Ordered work over groups of any size.

A plain `row_number()` or `lag()` over (partition by key order by time) sorts a whole group in one
task; a key that holds a third of all rows makes that task as large as a third of the data. The
helpers here cut every group into slices of the order itself (for example hours of the time
column), number or look back inside the slices, and connect the slices with one small row each.
A slice is derived from the row's own value, so a retried task sees the same slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(df: DataFrame, keys: Sequence[str], slice_by: Column) -> DataFrame:
    """Add `_cell`, the group and slice of a row. Struct equality holds for NULL keys as well."""
    group = F.struct(*[F.col(k) for k in keys])
    return df.withColumn("_cell", F.struct(group.alias("group"), slice_by.alias("slice")))


def _earlier() -> Window:
    return Window.partitionBy(F.col("_cell.group")).orderBy(F.col("_cell.slice"))


def group_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, out: str
) -> DataFrame:
    """row_number() per `keys` in `order`. `slice_by` must not decrease along `order`.

    Rows shuffle once, by cell; only one count per cell crosses cells. Counts are read off the numbered rows, so
    both sides of the join stand on the same exchange.
    """
    inside = Window.partitionBy("_cell").orderBy(*order)
    cells = _cells(df, keys, slice_by).withColumn("_rn", F.row_number().over(inside))
    counts = cells.groupBy("_cell").agg(F.max("_rn").alias("_n"))
    before = F.sum("_n").over(_earlier().rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        cells.join(offsets, "_cell")
        .withColumn(out, (F.col("_rn") + F.col("_before")).cast("bigint"))
        .select(*df.columns, out)
    )


def group_lag(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    values: dict[str, str],
) -> DataFrame:
    """`lag(column)` per `keys` in `order` for every `{output: column}` of `values`.

    Only the first row of a cell needs its predecessor from outside: the last row of the nearest
    earlier cell that has rows, found among one row per cell.
    """
    row = F.struct(*[F.col(c).alias(o) for o, c in values.items()])
    position = F.struct(*[F.col(c) for c in order])
    inside = Window.partitionBy("_cell").orderBy(*order)
    looked = _cells(df, keys, slice_by).withColumn("_prev", F.lag(row).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    lasts = looked.groupBy("_cell").agg(F.max_by(row, position).alias("_last"))
    carried = lasts.select("_cell", F.lag("_last").over(_earlier()).alias("_carry"))
    previous = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return (
        looked.join(carried, "_cell")
        .withColumn("_p", previous)
        .select(*df.columns, *[F.col("_p")[o].alias(o) for o in values])
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str) -> DataFrame:
    """The first k rows per key with their number.

    `row_number() <= k` lets Spark keep only k rows per key and map task before the shuffle
    (WindowGroupLimit), so a hot key never meets in one task.
    """
    numbered = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(out) <= k)
