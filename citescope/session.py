"""Session defaults. On a cluster the settings given at submit time win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Custom state with expiry needs this state store.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Long expressions build much faster without a captured call site per function call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # One row may carry a page of 3 MB: keep the Arrow batches of the shred pass small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def build_session(app_name: str = "citescope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; `conf` overrides them (use `_` for `.`-less keys)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Set the defaults that can change at run time on a session somebody else created."""
    for key in (
        "spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch",
        "spark.sql.streaming.stateStore.providerClass",
    ):
        spark.conf.set(key, DEFAULTS[key])
    return spark
