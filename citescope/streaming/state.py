"""N4 (built-in form), N7: state per key that expires with event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as K

_DAY_MS = 24 * 3600 * 1000


def _ms(stamp) -> int:
    return int(pd.Timestamp(stamp).timestamp() * 1000)


def dedupe_within_24h(requests: DataFrame, ts: str = "ts", hours: int = K.CACHE_HOURS) -> DataFrame:
    """N4 built-in form: one request per key until the watermark passes it. Expiry is event-time based,
    so it may keep a key longer than `decisions.stream_reuse`, never shorter."""
    return requests.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark(["cache_key"])


class Latest(StatefulProcessor):
    """The newest records of one site, forgotten `days` after the newest one (event time)."""

    def __init__(self, keep: int, days: int) -> None:
        self._keep, self._ttl = keep, days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._records = handle.getListState("records", "ts timestamp, record_id bigint, score bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(self._records.get()) if self._records.exists() else []
        if not known:
            first = next(rows)
            self._handle.registerTimer(_ms(first["ts"].max()) + self._ttl)
            known = self._merge(known, first)
        for batch in rows:
            known = self._merge(known, batch)
        self._records.put(known)
        out = pd.DataFrame(known, columns=["ts", "record_id", "score"])
        out.insert(0, "site", key[0])
        out["hist_no"] = range(1, len(out) + 1)
        yield out

    def _merge(self, known: list, batch: pd.DataFrame) -> list:
        # Only a batch's own newest can be among the newest of all.
        newest = batch.sort_values(["ts", "record_id"], ascending=False)[: self._keep]
        fresh = zip([t.to_pydatetime() for t in newest["ts"]], newest["record_id"], newest["score"])
        rows = [tuple(r) for r in known] + [(t, int(i), int(s)) for t, i, s in fresh]
        return sorted(rows, key=lambda r: (r[0], r[1]), reverse=True)[: self._keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = list(self._records.get()) if self._records.exists() else []
        expiry = _ms(known[0][0]) + self._ttl if known else 0
        if expiry > timerValues.getCurrentWatermarkInMs():
            self._handle.registerTimer(expiry)
        else:
            self._records.clear()
        return iter([])

    def close(self) -> None:
        pass


def latest_30_state(history: DataFrame, keep: int = K.HISTORY_KEEP, days: int = K.HISTORY_DAYS) -> DataFrame:
    """After each batch the newest records of every site that changed.

    Input: site string, ts timestamp, record_id bigint, score bigint.
    """
    return (
        history.select("site", "ts", "record_id", "score")
        .withWatermark("ts", "2 days")
        .groupBy("site")
        .transformWithStateInPandas(
            Latest(keep, days), "site string, ts timestamp, record_id bigint, score bigint, hist_no bigint",
            "Update", "EventTime",
        )
    )
