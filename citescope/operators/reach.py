"""G13, G17 at scale: how many different domains answers cite, from daily sketches that merge.

Exact distinct counts over a window read all runs of the window again. A day's sketch (HyperLogLog, a few kB) is written once
and any window is the union of its days. With `lg_k` the relative standard error is about 1.04 / sqrt(2 ** lg_k).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14


def daily_reach(outcomes: DataFrame, keys: Sequence[str], ts: str = "ts", lg_k: int = LG_K) -> DataFrame:
    """Per keys, engine and day: valid runs, citations and the sketch of cited domains. Sketches are summed per task first."""
    valid = outcomes.where(F.col("status") == "valid").withColumn("day", F.to_date(ts))
    cited = valid.select(*keys, "engine", "day", F.lit(0).alias("_run"), F.explode("cited_domains").alias("_domain"))
    runs = valid.select(*keys, "engine", "day", F.lit(1).alias("_run"), F.lit(None).cast("string").alias("_domain"))
    return cited.unionByName(runs).groupBy(*keys, "engine", "day").agg(
        F.sum("_run").alias("valid_runs"), F.count("_domain").alias("citations"),
        F.hll_sketch_agg("_domain", lg_k).alias("domain_sketch"),
    )


def reach(days: DataFrame, keys: Sequence[str], since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Any window of `daily_reach`: runs, citations and about how many different domains were cited. `until` is exclusive."""
    window = days
    if since is not None:
        window = window.where(F.col("day") >= since)
    if until is not None:
        window = window.where(F.col("day") < until)
    return window.groupBy(*keys, "engine").agg(
        F.count_distinct("day").alias("days"), F.sum("valid_runs").alias("valid_runs"), F.sum("citations").alias("citations"),
        F.hll_sketch_estimate(F.hll_union_agg("domain_sketch")).alias("domains"),
    )


def exact_reach(outcomes: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """The exact count beside it, for checks."""
    valid = outcomes.where(F.col("status") == "valid")
    cited = valid.select(*keys, "engine", F.explode("cited_domains").alias("_domain"))
    return cited.groupBy(*keys, "engine").agg(F.count_distinct("_domain").alias("exact_domains"))
