"""Where intermediate tables go: a shared folder, never a worker's own disk.

`spark.checkpoint.dir` names it. Without that setting it is a folder below the warehouse, which all executors of a
cluster share as well; a local session has its warehouse on the one machine there is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def named_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_runs"


def run_folder(spark: SparkSession) -> str:
    """A new folder for one run."""
    return f"{named_folder(spark)}/run-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to a new folder of the shared storage and read it back: cuts lineage, survives lost executors."""
    path = run_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The path's own file system, and the path in its form."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete folders `batch=<number>` below `path`, in order."""
    system, found = file_system(spark, path)
    if not system.exists(found):
        return []
    names = [status.getPath().getName() for status in system.listStatus(found)]
    numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return [n for n in numbers if path_exists(spark, f"{path}/batch={n}/_SUCCESS")]


def newest_batch(spark: SparkSession, path: str, below: int) -> str | None:
    """The newest complete batch folder whose number is below `below`: a batch without rows may have written none."""
    numbers = [n for n in finished_batches(spark, path) if n < below]
    return f"{path}/batch={numbers[-1]}" if numbers else None


def forget_batches(spark: SparkSession, path: str, below: int) -> None:
    """Drop batch folders that no retry can need: all before the newest one below `below`."""
    for number in [n for n in finished_batches(spark, path) if n < below][:-1]:
        system, found = file_system(spark, f"{path}/batch={number}")
        system.delete(found, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system; every other error comes out."""
    system, found = file_system(spark, path)
    return system.exists(found)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint reliably: a lost executor then costs no recomputation from the start."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named_folder(df.sparkSession))
    return df.checkpoint()
