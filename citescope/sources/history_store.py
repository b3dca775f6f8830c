"""A9 for long histories: day folders as they are appended, and buckets by domain for everything that is closed.

Appends leave many small files, one or more per day. `compact_history` moves closed months into a table that is partitioned by
month and bucketed and sorted by domain, one file per bucket and month; every month is rewritten once. Rankings and
differences per domain then read each bucket where it lies: no exchange of the history (M1, M2 with `slice_unit=None`).

A bucket holds whole domains, so a domain with a large share of all records makes one large, sorted file that one task
streams through. Where that is too long, `score_delta` over the day folders cuts the domain into slices instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import file_system

BUCKETS = 64


def _marks(spark: SparkSession, path: str, kind: str) -> str:
    return f"{path}/{kind}-compacted"


def compacted_months(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Months that are complete in the table: a month counts once its mark is written, after its files."""
    system, folder = file_system(spark, _marks(spark, path, kind))
    return sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []


def _month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def compact_history(
    spark: SparkSession, path: str, kind: str, table: str, before: Column, buckets: int = BUCKETS, key: str = "domain", ts: str = "ts"
) -> list[str]:
    """Move all months that end before the date `before` from `path/kind` into `table`; gives the months moved.

    Day folders of a moved month are dropped by `drop_compacted_days`. What a run that died has left of a month is dropped here.
    """
    done = compacted_months(spark, path, kind)
    days = spark.read.parquet(f"{path}/{kind}").withColumn("month", _month(F.col("day")))
    closed = days.where((F.last_day("day") < before) & ~F.col("month").isin(done))
    months = [r["month"] for r in closed.select("month").distinct().collect()]
    if not months:
        return []
    system, folder = file_system(spark, f"{path}/{kind}-buckets")
    for month in months:
        half = file_system(spark, f"{path}/{kind}-buckets/month={month}")[1]
        if system.exists(half):
            system.delete(half, True)
    (
        closed.repartition(buckets, key).write.format("parquet").mode("append").option("path", f"{path}/{kind}-buckets")
        .partitionBy("month").bucketBy(buckets, key).sortBy(key, ts).saveAsTable(table)
    )
    for month in months:
        system.create(file_system(spark, f"{_marks(spark, path, kind)}/{month}")[1], True).close()
    return sorted(months)


def drop_compacted_days(spark: SparkSession, path: str, kind: str) -> int:
    """Delete the day folders of all moved months, once no reader of the folders runs any more; gives their number."""
    done = set(compacted_months(spark, path, kind))
    system, folder = file_system(spark, f"{path}/{kind}")
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    old = [n for n in names if n.startswith("day=") and n.removeprefix("day=")[:7] in done]
    for name in old:
        system.delete(file_system(spark, f"{path}/{kind}/{name}")[1], True)
    return len(old)


def compacted_history(spark: SparkSession, path: str, kind: str, table: str, since: Column | None = None) -> DataFrame:
    """The moved months; `since` (a date) prunes whole months and then days."""
    rows = spark.table(table).where(F.col("month").isin(compacted_months(spark, path, kind)))
    if since is not None:
        rows = rows.where((F.col("month") >= _month(since)) & (F.col("day") >= since))
    return rows.drop("month")
