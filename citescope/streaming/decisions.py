"""Caps and reuse over streams, decided in the micro-batch a request arrives in.

What a decision needs of the past is keyed state: the requests of every address of a bucket on a day so far, the time until which a result
runs. Both end by event-time timers, so state holds open days and running results only. Requests that come after their
day is closed (caps) or behind the watermark (reuse) change nothing any more; they leave as `late` rows, never unseen.

The number of a request within its whole day is one counter for everybody. It isn't kept as state of one key, which one
task would count up: a micro-batch is numbered in slices of time like the batch twin, and only one number per open day goes
on to the next batch.

Requests of one batch count in order of time, batches in order of arrival: on a stream in time order the decisions are those
of the batch twin. A bucket of addresses or a cache key holds the rows of one micro-batch in memory to sort them, so the
trigger's size (`maxFilesPerTrigger`, `maxBytesPerTrigger`) bounds a task, however busy a key is.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from ..functions import constants as K
from ..functions.ordered import group_row_number
from ..functions.storage import forget_batches, newest_batch

_DAY_MS = 24 * 3600 * 1000
#: Groups of addresses of one day. A call of Python and its state serve a bucket, not an address.
_BUCKETS = 64


def _with_watermark(requests: DataFrame, ts: str, late: str) -> DataFrame:
    """A watermark on a copy of the time: operators that keep no column of it drop no late row, but know the watermark."""
    return requests.withColumn("_seen", F.col(ts)).withWatermark("_seen", late)


def _frames(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of the micro-batch in order of time."""
    return pd.concat(list(rows), ignore_index=True).sort_values(["us", "place"], kind="stable", ignore_index=True)


class _Numbers(StatefulProcessor):
    """Running numbers of the requests of a bucket of addresses on one day, until the day is closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._counts = handle.getListState("counts", "ip string, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _frames(rows)
        closes = ((frame["day"].iloc[0] - date(1970, 1, 1)).days + 1) * _DAY_MS
        late = closes <= timerValues.getCurrentWatermarkInMs()
        numbers = [None] * len(frame)
        if not late:
            exists = self._counts.exists()
            known = {ip: n for ip, n in self._counts.get()} if exists else {}
            for i, ip in enumerate(frame["ip"]):
                ip = ip if isinstance(ip, str) else None
                numbers[i] = known[ip] = known.get(ip, 0) + 1
            if not exists:
                self._handle.registerTimer(closes)
            self._counts.put(list(known.items()))
        yield frame[["packed", "day"]].assign(ip_no=pd.Series(numbers, dtype="object"), late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._counts.clear()
        return iter([])

    def close(self) -> None:
        pass


#: Times inside of structs and lists keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _packed(requests: DataFrame, ts: str, order: str, *keys: Column) -> DataFrame:
    """The row as it came in one text, which pandas doesn't take apart, beside what the operator reads of it."""
    row = F.struct(*[
        F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name)
        for f in requests.schema.fields if f.name != "_seen"
    ])
    return requests.select(*keys, F.unix_micros(ts).alias("us"), F.col(order).alias("place"), F.to_json(row, _JSON).alias("packed"))


def _unpacked(rows: DataFrame, schema: StructType) -> DataFrame:
    """The columns of `schema` out of `packed`, then the others."""
    times = {f.name for f in schema.fields if isinstance(f.dataType, TimestampType)}
    plain = StructType([StructField(f.name, LongType() if f.name in times else f.dataType) for f in schema.fields])
    others = [c for c in rows.columns if c != "packed"]
    back = [F.col("_row")[f.name] for f in schema.fields]
    named = [(F.timestamp_micros(c) if f.name in times else c).alias(f.name) for c, f in zip(back, schema.fields)]
    return rows.select(F.from_json("packed", plain, _JSON).alias("_row"), *others).select(*named, *others)


def address_numbers(requests: DataFrame, ip: str = "ip_hash", ts: str = "ts", order: str = "request_id", late: str = "2 days") -> DataFrame:
    """Stream of requests with day, `ip_no` (number within address and day) and `late`."""
    address, bucket = F.col(ip).cast("string").alias("ip"), F.pmod(F.xxhash64(F.col(ip)), F.lit(_BUCKETS)).alias("bucket")
    rows = _packed(_with_watermark(requests, ts, late), ts, order, F.to_date(ts).alias("day"), address, bucket)
    schema = "packed string, day date, ip_no bigint, late boolean"
    numbered = rows.groupBy("day", "bucket").transformWithStateInPandas(_Numbers(), schema, "Append", "EventTime")
    return _unpacked(numbered, requests.schema)


def _days_so_far(batch: DataFrame, path: str, number: int) -> DataFrame:
    """day, n: requests within their address's cap, per open day, of all batches before."""
    before = newest_batch(batch.sparkSession, f"{path}/days", number)
    if before is None:
        return batch.sparkSession.createDataFrame([], "day date, n bigint")
    return batch.sparkSession.read.schema("day date, n bigint").parquet(before)


def _decide(
    path: str, per_ip: int, cap: int, ts: str, order: str, slice_unit: str, days_open: int,
):
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{path}/numbered/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        rows = spark.read.schema(batch.schema).parquet(folder)
        if rows.isEmpty():
            return
        rows.where("late").drop("late", "ip_no").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        ok = F.coalesce(F.col("ip_no") <= per_ip, F.lit(False)) if per_ip > 0 else F.lit(True)
        earlier = _days_so_far(batch, path, number)
        # Blocked requests get their own group, so they never move the count of the others.
        cut = F.date_trunc(slice_unit, F.col(ts))
        marked = rows.where("NOT late").drop("late").withColumn("_ok", ok)
        numbered = group_row_number(marked, ["day", "_ok"], [ts, order], cut, "_no").join(
            earlier.withColumnRenamed("n", "_before"), "day", "left"
        )
        place = F.when(F.col("_ok"), F.col("_no") + F.coalesce("_before", F.lit(0))) if cap > 0 else F.lit(None).cast("bigint")
        counted = numbered.withColumn("global_no", place)
        decision = (
            F.when(~F.col("_ok"), "ip-blocked")
            .when(F.coalesce(F.col("global_no") > cap, F.lit(False)), "global-blocked")
            .otherwise("allowed")
        )
        out = counted.withColumn("decision", decision).drop("_no", "_before")
        out.drop("_ok").write.mode("overwrite").parquet(f"{path}/decided/batch={number}")
        # An address's cap decides alone which requests count, so the day's count needs no decision.
        now = marked.where("_ok").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
        days = now.unionByName(earlier).groupBy("day").agg(F.sum("n").alias("n"))
        newest = F.date_sub(F.lit(rows.agg(F.max("day")).first()[0]), days_open)
        days.where(F.col("day") >= newest).coalesce(1).write.mode("overwrite").parquet(f"{path}/days/batch={number}")
        forget_batches(spark, f"{path}/days", number)
        forget_batches(spark, f"{path}/numbered", number)

    return handle


def cap_decisions(
    requests: DataFrame, path: str, checkpoint: str, per_ip: int, cap: int, ip: str = "ip_hash", ts: str = "ts",
    order: str = "request_id", late_days: int = 2, slice_unit: str = "hour",
) -> DataStreamWriter:
    """Writer for a stream of requests; a cap of 0 is off.

    `path/decided` gets every request with ip_no, global_no and decision, `path/late` the ones whose day was closed, a
    folder per micro-batch that a retry writes again. `path/days` is the one count per open day.
    """
    numbered = address_numbers(requests, ip, ts, order, f"{late_days} days")
    handle = _decide(path, per_ip, cap, ts, order, slice_unit, late_days + 2)
    return numbered.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)


class _Running(StatefulProcessor):
    """Until when a key's result runs."""

    def __init__(self, width: int) -> None:
        self._width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._until = handle.getValueState("until", "us bigint")

    @staticmethod
    def _over_ms(until: int) -> int:
        """The first full millisecond later than `until`."""
        return until // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_from = timerValues.getCurrentWatermarkInMs() * 1000
        before = self._until.get()[0] if self._until.exists() else None
        until = before
        frame = _frames(rows)
        us = frame["us"].to_numpy(np.int64)
        at = int(np.searchsorted(us, open_from))
        decisions = np.full(len(us), "reuse", object)
        decisions[:at] = "late"
        while at < len(us):
            if until is not None and us[at] <= until:
                # From run to run, over all that reuses.
                at = max(at, int(np.searchsorted(us, until, "right")))
                continue
            decisions[at], until = "run", int(us[at]) + self._width
            at += 1
        if until != before:
            self._until.update((until,))
            self._handle.registerTimer(self._over_ms(until))
        yield frame[["packed"]].assign(decision=decisions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A newer run has set its own timer.
        if self._until.exists() and self._over_ms(self._until.get()[0]) <= timerValues.getCurrentWatermarkInMs():
            self._until.clear()
        return iter([])

    def close(self) -> None:
        pass


def reuse_decisions(
    requests: DataFrame, key: str = "cache_key", ts: str = "ts", order: str = "request_id",
    hours: int = K.CACHE_HOURS, late: str = "2 days",
) -> DataFrame:
    """Stream of requests with `decision`: run, reuse, or late for one behind the watermark."""
    rows = _packed(_with_watermark(requests, ts, late), ts, order, F.col(key).alias("key"))
    running = _Running(hours * 3600 * 1_000_000)
    decided = rows.groupBy("key").transformWithStateInPandas(running, "packed string, decision string", "Append", "EventTime")
    return _unpacked(decided, requests.schema)
