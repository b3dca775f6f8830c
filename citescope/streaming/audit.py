"""Score pages as they arrive, with the robots answer of their host, and report the change of every domain.

Pages and robots answers are two streams. An answer holds for the pages fetched in the same clock hour, as the crawler asks
for it once per host and visit; an interval join with watermarks on both sides keeps a page's signals, never its HTML, until
the answer comes or can't come any more. The newest record of every domain is keyed state: it stands over batches without
rows and restarts, and a new checkpoint can begin with the newest records of an existing history.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..functions.urls import registrable_domain
from ..operators.robots import robots_summary
from ..operators.scoring import page_scores
from ..operators.signals import page_signals
from ..sources.readers import with_host

RECORD = "domain string, page_id bigint, url string, ts timestamp, score int, band string, tech_score int, content_score int, crawl string"


def robots_answers(robots: DataFrame, late: str) -> DataFrame:
    """One summary per host and clock hour, the first that arrives: host, robots_ts, robots."""
    hour = robots.withColumn("_hour", F.date_trunc("hour", "ts")).withWatermark("ts", late)
    first = hour.dropDuplicatesWithinWatermark(["host", "_hour"])
    judged = robots_summary(first.withColumn("_at", F.struct("host", "ts")), "_at")
    fields = [c for c in judged.columns if c != "_at"]
    return judged.select(F.col("_at.host").alias("robots_host"), F.col("_at.ts").alias("robots_ts"), F.struct(*fields).alias("robots"))


def profiles(pages: DataFrame, robots: DataFrame | None = None, late: str = "1 hour") -> DataFrame:
    """Signals of every page, with `robots` where a stream of answers (host, ts, status, content_type, body) is given.

    A page waits for its answer; without one it leaves when the watermark has passed its hour, as "absent".
    """
    wide = with_host(page_signals(pages, keep=["page_id", "url", "ts"]), "url")
    if robots is None:
        return wide
    answers = robots_answers(robots, late)
    same_hour = (
        (F.col("host") == F.col("robots_host"))
        & (F.date_trunc("hour", "ts") == F.date_trunc("hour", "robots_ts"))
        & F.col("robots_ts").between(F.col("ts") - F.expr("INTERVAL 1 HOUR"), F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    )
    joined = wide.withWatermark("ts", late).join(answers, same_hour, "left_outer")
    return joined.drop("robots_host", "robots_ts")


def score_records(profiled: DataFrame) -> DataFrame:
    """Records of RECORD's columns; `crawl` is the state of the crawl item."""
    scored = page_scores(profiled, ["page_id", "url", "ts"])
    crawl = F.get(F.filter("items", lambda i: i["key"] == "crawl"), F.lit(0))["status"]
    return scored.select(
        registrable_domain("url").alias("domain"), "page_id", "url", "ts", "score", "band", "tech_score", "content_score",
        crawl.alias("crawl"),
    )


class _Newest(StatefulProcessor):
    """The newest record of a domain. Records of a batch are taken in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "us bigint, page_id bigint, score int")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._last.update((initialState["us"], initialState["page_id"], initialState["score"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = tuple(self._last.get()) if self._last.exists() else None
        for row in sorted(rows, key=lambda r: (r["us"], r["page_id"])):
            before = last[2] if last else None
            yield Row(**row["record"], prev_score=before, delta=None if before is None else row["record"]["score"] - before)
            last = max(last or (-1 << 63, 0, 0), (row["us"], row["page_id"], row["record"]["score"]))
        self._last.update(last)

    def close(self) -> None:
        pass


def newest(records: DataFrame) -> DataFrame:
    """Snapshot of a history: the newest record of every domain, as initial state of `with_previous`."""
    found = records.groupBy("domain").agg(F.max(F.struct(F.unix_micros("ts").alias("us"), "page_id", "score")).alias("_r"))
    return found.select("domain", "_r.*")


def with_previous(records: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Stream of records with the score before each one and the change.

    A record that is older than its domain's newest one is compared with that. `snapshot` (see `newest`) is read when the
    checkpoint is new.
    """
    # The time travels as a number: a page that waited for its answer is behind the watermark and must not be dropped.
    plain = records.select("domain", F.unix_micros("ts").alias("us"), "page_id", F.struct(*records.columns).alias("record"))
    start = None if snapshot is None else snapshot.groupBy("domain")
    return plain.groupBy("domain").transformWithState(
        _Newest(), f"{RECORD}, prev_score int, delta int", "Append", "None", start
    )


def stream_audit(
    pages: DataFrame, path: str, checkpoint: str, robots: DataFrame | None = None, late: str = "1 hour",
    snapshot: DataFrame | None = None,
) -> DataStreamWriter:
    """Writer for a stream of pages (page_id, url, ts, html): `path/score/batch=<id>` with one folder per day.

    Every record carries prev_score and delta. A batch writes its own folder only, again on a retry.
    """
    records = with_previous(score_records(profiles(pages, robots, late)), snapshot)

    def handle(batch: DataFrame, number: int) -> None:
        batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/score/batch={number}")

    return records.writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)
