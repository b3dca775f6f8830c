"""Tables of months with atomic commits.

A write adds a version folder with the months it changes; a manifest, one small JSON file per commit, says which version
of which month counts. Readers follow the newest manifest, so a writer that dies before its commit leaves everything as it
was, and a commit becomes visible at once. Two writers: the second one's manifest number is taken, so it looks
at what came in between. Months of others change nothing for it; its own months are merged again.

A commit is a rename that fails if the target exists. File systems with atomic renames (HDFS, a local disk) give the
guarantee; on object stores it needs a committer with put-if-absent.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import file_system

Months = dict[str, str]


class Conflict(RuntimeError):
    """Another writer committed first."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all commits, oldest first."""
    system, folder = file_system(spark, f"{path}/commits")
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def months_of(spark: SparkSession, path: str, version: int) -> Months:
    """Which version folder holds each month at a commit; none at 0."""
    if not version:
        return {}
    system, found = file_system(spark, f"{path}/commits/{version}.json")
    stream = system.open(found)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, path: str) -> tuple[int, Months]:
    known = versions(spark, path)
    number = known[-1] if known else 0
    return number, months_of(spark, path, number)


def _commit(spark: SparkSession, path: str, number: int, months: Months) -> None:
    system, draft = file_system(spark, f"{path}/commits/.{uuid.uuid4().hex}")
    out = system.create(draft, False)
    try:
        out.write(bytearray(json.dumps(months, sort_keys=True).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else (
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    )
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{number}.json"), none)
    except Py4JJavaError as error:
        system.delete(draft, False)
        if "AlreadyExists" in error.java_exception.getClass().getName():
            raise Conflict(f"commit {number} of {path} is taken") from error
        raise


def _folder(path: str, period: str, version: str) -> str:
    return f"{path}/data/v={version}/period={period}"


def read_months(spark: SparkSession, path: str, months: Months) -> DataFrame | None:
    """The rows of these months, `period` as string; None without a month."""
    folders = [_folder(path, p, v) for p, v in sorted(months.items())]
    if not folders:
        return None
    rows = spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*folders)
    # Folders read back as the type they look like; the month is a string.
    return rows.withColumn("period", F.col("period").cast("string")).drop("v")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at its newest commit, or at an earlier one that is still kept."""
    months = newest(spark, path)[1] if version is None else months_of(spark, path, version)
    rows = read_months(spark, path, months)
    if rows is None:
        raise ValueError(f"{path} has no commit")
    return rows


def merge(
    rows: DataFrame, path: str, combine: Callable[[DataFrame | None, DataFrame], DataFrame], attempts: int = 5,
    before_commit: Callable[[], None] | None = None,
) -> int:
    """Commit `combine(stored, rows)` for the months of `rows`; `stored` has those months as committed. Gives the commit number.

    Only these months are read and written. `before_commit` runs between the write and the commit (for tests).
    """
    spark = rows.sparkSession
    touched = [r["period"] for r in rows.select("period").distinct().collect()]
    if None in touched:
        raise ValueError("rows without a period")
    if not touched:
        return newest(spark, path)[0]
    for _ in range(attempts):
        base, months = newest(spark, path)
        own = {p: months[p] for p in touched if p in months}
        version = uuid.uuid4().hex
        merged = combine(read_months(spark, path, own), rows)
        merged.write.partitionBy("period").parquet(f"{path}/data/v={version}")
        if before_commit:
            before_commit()
        for number in range(base + 1, base + 1 + attempts):
            now = months if number == base + 1 else months_of(spark, path, number - 1)
            if {p: now[p] for p in touched if p in now} != own:
                break  # somebody changed these months: merge with theirs
            try:
                _commit(spark, path, number, {**now, **dict.fromkeys(touched, version)})
                return number
            except Conflict:
                continue
    raise Conflict(f"{path}: {attempts} attempts met other writers")


def forget(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Drop all commits but the newest `keep` and the version folders none of those names. Run it while nobody writes."""
    known = versions(spark, path)
    kept = {v for n in known[-keep:] for v in months_of(spark, path, n).values()}
    system, data = file_system(spark, f"{path}/data")
    names = [s.getPath().getName() for s in system.listStatus(data)] if system.exists(data) else []
    gone = [n for n in names if n.startswith("v=") and n.removeprefix("v=") not in kept]
    for name in gone:
        system.delete(file_system(spark, f"{path}/data/{name}")[1], True)
    for number in known[:-keep]:
        system.delete(file_system(spark, f"{path}/commits/{number}.json")[1], False)
    return gone
