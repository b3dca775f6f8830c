"""What the corpus operators share: tables, words, stored intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: everything but these six white-space characters. `bytes.split()` splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch. The usual 10,000 texts are held several times, in the JVM outside its heap and in Python.
_BATCH_KEY, _BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; none for a missing text."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Only a local master without that setting gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write to a new table in the shared folder and read it back: cuts lineage, survives lost executors.

    Nothing reads the shuffle files of a finished write again, so they go with it instead of whenever the driver's garbage is
    collected. Rows reach Python in batches of at most _BATCH whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in (_CLEANUP, _BATCH_KEY)}
    spark.conf.set(_CLEANUP, "true")
    if not 0 < int(before[_BATCH_KEY] or 0) <= _BATCH:
        spark.conf.set(_BATCH_KEY, _BATCH)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """`mapInArrow` with one dict of equally long columns per output batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in per_batch(batch):
                columns = [
                    out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (u, v): one row (node, root), root the smallest node reachable.

    Alternates large stars and small stars until the edges no longer change. Only counts reach the driver.
    Nodes without an edge don't appear. Each round is a stored table.
    """
    edges = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
