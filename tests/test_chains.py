"""Chains by doubling against a plain fold."""

import random
from datetime import datetime, timedelta

import pytest

from citescope.operators import limits

START = datetime(2024, 1, 1)
SCHEMA = "request_id long, ts timestamp, cache_key string"


def folded(rows, hours, running=()):
    until, out = dict(running), {}
    for i, ts, key in sorted(rows, key=lambda r: (r[1], r[0])):
        fresh = until.get(key) is None or ts > until[key]
        out[i] = "run" if fresh else "reuse"
        if fresh:
            until[key] = ts + timedelta(hours=hours)
    return out


@pytest.mark.parametrize(("hours", "span", "grid", "running"), [
    (24, 100, 1, ()), (24, 60, 43_200, ()), (1, 9, 60, ()), (24, 0, 1, ()), (24, 40, 3600, (("a", START + timedelta(days=20)), ("hot", START + timedelta(days=3, seconds=5)))),
])
def test_reuse(spark, hours, span, grid, running):
    """A third of all requests have one key; many fall on one moment or exactly on an expiry."""
    rnd = random.Random(hours + span)
    rows = [
        (i, START + timedelta(seconds=rnd.randrange(max(1, span * 86_400 // grid)) * grid), rnd.choice([None, "a", "b"]) if i % 3 else "hot")
        for i in range(1500)
    ]
    rows.append((5000, START + timedelta(days=3 * span + 400), "a"))
    earlier = spark.createDataFrame(list(running), "cache_key string, until timestamp") if running else None
    got = limits.reuse_decisions(spark.createDataFrame(rows, SCHEMA), hours=hours, running=earlier)
    assert got.columns == ["request_id", "ts", "cache_key", "decision"]
    assert {r["request_id"]: r["decision"] for r in got.collect()} == folded(rows, hours, running)


def test_no_requests(spark):
    assert limits.reuse_decisions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_busy_key_is_spread(spark):
    """All requests have one key: the joins and windows still deal them over many tasks."""
    rows = spark.range(0, 48_000, 1, 8).selectExpr("id request_id", "timestamp_seconds(1704067200 + id * 60) ts", "'hot' cache_key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = limits.reuse_decisions(rows)
        parts = got.groupBy(got["decision"]).count().collect()
        sizes = [n for n in got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # 33.3 days, each run a minute later than a day after the one before.
    assert {r["decision"]: r["count"] for r in parts} == {"run": 34, "reuse": 47_966}
    assert len(sizes) >= 8 and max(sizes) < 48_000 / 4
