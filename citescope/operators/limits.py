"""Caps and the result cache as batch operators; the streaming twins are in `citescope/streaming`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ordered import group_row_number
from ..functions.storage import stored
from . import chains


def daily_counts(events: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """N1, N2 batch twin: events per day (and key)."""
    return events.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def cap_decisions(
    requests: DataFrame, per_ip: int, global_cap: int, ip: str = "ip_hash", ts: str = "ts", order: str = "request_id",
    slice_unit: str = "hour",
) -> DataFrame:
    """N3 batch twin: per request ip-blocked, global-blocked or allowed; a cap of 0 is off.

    The address is checked first, and a request it blocks does not use up the global count. Both
    counts are exact running numbers cut into slices of time, so neither a busy address nor the
    whole day is ever sorted in one task.
    """
    day = requests.withColumn("day", F.to_date(ts))
    cut = F.date_trunc(slice_unit, F.col(ts))
    if per_ip > 0:
        numbered = group_row_number(day, ["day", ip], [ts, order], cut, "ip_no")
    else:
        numbered = day.withColumn("ip_no", F.lit(None).cast("bigint"))
    ip_ok = F.coalesce(F.col("ip_no") <= per_ip, F.lit(True))
    if global_cap > 0:
        # Blocked requests get their own group, so they never move the count of the others.
        counted = group_row_number(
            numbered.withColumn("_ok", ip_ok), ["day", "_ok"], [ts, order], cut, "_no"
        ).withColumn("global_no", F.when(F.col("_ok"), F.col("_no"))).drop("_ok", "_no")
    else:
        counted = numbered.withColumn("global_no", F.lit(None).cast("bigint"))
    decision = (
        F.when(~ip_ok, "ip-blocked")
        .when(F.coalesce(F.col("global_no") > global_cap, F.lit(False)), "global-blocked")
        .otherwise("allowed")
    )
    return counted.withColumn("decision", decision)


def reuse_decisions(
    requests: DataFrame, key: str = "cache_key", ts: str = "ts", order: str = "request_id",
    hours: int = K.CACHE_HOURS, running: DataFrame | None = None, slice_hours: float = 1,
) -> DataFrame:
    """N4 batch twin: a request reuses the result of the run that is not yet `hours` old.

    `running` (key, until timestamp) has results that were running before the first of these requests. `order` tells
    the requests of one key and time apart; the first of them is the one that may run.

    Expiry counts from the run itself, so one decision depends on the one before. The chain of a key's runs is found
    by `chains.reached`, so neither a busy key nor its history is ever folded in one task; `slice_hours` is the stretch of
    a key's requests that is sorted together.
    """
    width = hours * 3600 * 1_000_000
    timed = requests.withColumns({
        "_key": F.struct(F.col(key).alias("value")), "_us": F.unix_micros(F.col(ts).cast("timestamp")),
    })
    points = stored(timed.groupBy(F.col("_key").alias("key"), F.col("_us").alias("us")).agg(F.min(order).alias("first_order")))
    candidates = points
    if running is not None:
        untils = running.groupBy(F.struct(F.col(key).alias("value")).alias("key")).agg(F.max(F.unix_micros("until")).alias("until"))
        candidates = points.join(untils, "key", "left").where(F.col("until").isNull() | (F.col("us") > F.col("until")))
    starts = candidates.groupBy("key").agg(F.min("us").alias("us"))
    runs = chains.reached(points, starts, width, int(slice_hours * 3600 * 1_000_000)).join(points, ["key", "us"])
    named = runs.select(
        F.col("key").alias("_key"), F.col("us").alias("_us"), F.col("first_order").alias(order), F.lit(True).alias("_run")
    )
    decision = F.when(F.col("_run"), "run").otherwise("reuse")
    return timed.join(named, ["_key", "_us", order], "left").select(*requests.columns, decision.alias("decision"))
