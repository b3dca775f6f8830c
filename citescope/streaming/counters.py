"""Running counts and the running panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.stats import ratio, wilson
from ..operators.panel import citation_panel_of, prompt_counts, unmeasurable_reason
from ..operators.views import hash_ip


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """Events per UTC day. Append mode emits a day when the watermark has passed it."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day").alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("_w.start").alias("day"), "n")
    )


def daily_counts_by_ip(events: DataFrame, ip: str = "ip", ts: str = "ts", late: str = "2 days") -> DataFrame:
    """The same per hashed address."""
    hashed = events.withColumn("ip_hash", hash_ip(F.col(ip).cast("string")))
    return (
        hashed.withWatermark(ts, late)
        .groupBy("ip_hash", F.window(ts, "1 day").alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("ip_hash", F.to_date("_w.start").alias("day"), "n")
    )


def running_panel(
    outcomes: DataFrame, keys: Sequence[str], ts: str = "ts", window: str = "30 days", late: str = "2 days"
) -> DataFrame:
    """Panel per engine and window; rate and interval are computed after the aggregation."""
    status = F.col("status")
    counted = (
        outcomes.withWatermark(ts, late)
        .groupBy(*keys, "engine", F.window(ts, window).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count_if(status == "error").alias("errored_runs"),
            F.count_if(status == "inconclusive").alias("inconclusive_runs"),
            F.count_if(status == "valid").alias("valid_runs"),
            F.count_if((status == "valid") & F.col("cited")).alias("cited_runs"),
            F.count_if((status != "error") & F.col("named")).alias("named_runs"),
        )
    )
    interval = F.when((F.col("cited_runs") > 0) & (F.col("valid_runs") >= 2), wilson("cited_runs", "valid_runs"))
    measured = F.col("valid_runs") > 0
    return counted.select(
        *keys, "engine", F.col("_w.start").alias("window_start"), "attempts", "errored_runs",
        "inconclusive_runs", "valid_runs", "cited_runs", "named_runs",
        F.coalesce(F.round(ratio("cited_runs", "valid_runs"), 2), F.lit(0.0)).alias("hit_rate"),
        interval["low"].alias("ci_low"), interval["high"].alias("ci_high"), measured.alias("measured"),
        unmeasurable_reason(measured, F.col("errored_runs"), F.col("inconclusive_runs")).alias("unmeasurable"),
    )


def prompt_windows(
    outcomes: DataFrame, keys: Sequence[str], ts: str = "ts", window: str = "30 days", late: str = "2 days"
) -> DataFrame:
    """Counts per prompt, engine and window. Append mode emits a window when the watermark has passed it."""
    timed = outcomes.withWatermark(ts, late).withColumn("_w", F.window(ts, window))
    return prompt_counts(timed, [*keys, "_w"])


def closed_panel(
    outcomes: DataFrame, keys: Sequence[str], ts: str = "ts", window: str = "30 days", late: str = "2 days",
    repeats: int = K.MAX_REPEATS,
) -> DataFrame:
    """N6 with G8 to G12: engine rows of closed windows with their distribution over prompts.

    Two aggregations in a chain: prompts first, then engines over the prompts' counts. The second one waits for the
    watermark that the first passes on, so a window is final in both. Append mode.
    """
    rows = citation_panel_of(prompt_windows(outcomes, keys, ts, window, late), [*keys, "_w"], repeats)
    return rows.withColumn("window_start", F.col("_w.start")).drop("_w")
