"""Streams give what their batch twins give on the same rows."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citescope.operators import history, limits
from citescope.operators.panel import citation_panel
from citescope.streaming import audit, counters, decisions, state
from citescope.streaming.late import LateRows, dropped_so_far

START = datetime(2024, 1, 1)
REQUEST = "request_id bigint, ts timestamp, ip_hash string, cache_key string, site string, record_id bigint, score bigint"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, START + timedelta(minutes=97 * i), f"ip{i % 3}", f"k{i % 4}", f"s{i % 2}", i, i % 101) for i in range(120)]
    return spark.createDataFrame(data, REQUEST)


def stream_of(spark, df, folder, parts=1):
    df.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(stream, folder, name, mode="update"):
    def keep(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/{name}/b={number}")

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/{name}-cp").trigger(availableNow=True).start()
    assert q.awaitTermination(60), q.stop()
    return stream.sparkSession.read.parquet(f"{folder}/{name}").drop("b")


def shuffled(spark, df, folder, files=4):
    """The rows in no order, in several files, each a micro-batch; a day's rows are spread over two files at most."""
    width = df.count() // files
    for k, part in enumerate([df.orderBy("ts").collect()[a : a + width] for a in range(0, df.count(), width)]):
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def written(spark, stream, folder):
    """Every micro-batch of a stream of decisions, and the state rows each left behind."""
    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120), query.stop()
    return spark.read.parquet(f"{folder}/out"), [p.stateOperators[0].numRowsTotal for p in query.recentProgress]


def test_reuse_stream(spark, rows, folder):
    got, state_rows = written(spark, decisions.reuse_decisions(shuffled(spark, rows, folder)), folder)
    twin = limits.reuse_decisions(rows).select("request_id", "decision")
    assert sorted(map(tuple, got.select("request_id", "decision").collect())) == sorted(map(tuple, twin.collect()))
    # One row and one timer a key, whatever the length of the stream.
    assert got.select("batch").distinct().count() >= 4 and max(state_rows) <= 4 * 3


def test_late_reuse_requests_are_marked(spark, folder):
    days = [[(0, 0), (1, 9)], [(2, 8), (3, 3), (4, 9)], [(5, 12)], [(6, 12)]]
    for number, batch in enumerate(days):
        data = [(i, START + timedelta(days=d, hours=i), "ip", "k", "s", i, 0) for i, d in batch]
        spark.createDataFrame(data, REQUEST).coalesce(1).write.parquet(f"{folder}/in/{number}")
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    got, _ = written(spark, decisions.reuse_decisions(source), folder)
    decision = {r["request_id"]: r["decision"] for r in got.collect()}
    # After day 9 was seen, day 3 is behind the watermark; day 8 isn't, but lies before the run that still holds.
    assert decision == {0: "run", 1: "run", 2: "reuse", 3: "late", 4: "reuse", 5: "run", 6: "reuse"}


def cap_stream(spark, source, folder, per_ip, cap):
    query = decisions.cap_decisions(source, folder, f"{folder}/cp", per_ip, cap).trigger(availableNow=True).start()
    assert query.awaitTermination(120), query.stop()
    return spark.read.parquet(f"{folder}/decided"), spark.read.parquet(f"{folder}/late"), query.recentProgress


CAP_COLUMNS = ["request_id", "ip_no", "global_no", "decision"]


@pytest.mark.parametrize(("per_ip", "cap"), [(4, 11), (0, 11)])
def test_cap_stream(spark, rows, folder, per_ip, cap):
    got, late, progress = cap_stream(spark, shuffled(spark, rows, folder), folder, per_ip, cap)
    twin = limits.cap_decisions(rows, per_ip, cap)
    expected = sorted(str(r) for r in twin.select(CAP_COLUMNS).collect())
    if per_ip == 0:  # the stream always numbers addresses
        expected = sorted(str(r) for r in limits.cap_decisions(rows, 10_000, cap).select(CAP_COLUMNS).collect())
    assert sorted(str(r) for r in got.select(CAP_COLUMNS).collect()) == expected
    assert late.count() == 0
    # Decided in the batch of arrival: four files, four batches with rows.
    assert got.select("batch").distinct().count() == len([p for p in progress if p.numInputRows])
    # The last batch again, as after a failure.
    before, last = sorted(str(r) for r in got.collect()), max(r["batch"] for r in got.select("batch").distinct().collect())
    spark.read.parquet(f"{folder}/numbered/batch={last}").write.parquet(f"{folder}/again")
    decisions._decide(folder, per_ip, cap, "ts", "request_id", "hour", 4)(spark.read.parquet(f"{folder}/again"), last)
    assert sorted(str(r) for r in spark.read.parquet(f"{folder}/decided").collect()) == before


def test_caps_keep_open_days_only(spark, folder):
    days = 7
    data = [(d * 100 + i * 10 + j, START + timedelta(days=d, minutes=j), f"ip{i}", "k", "s", 0, 0) for d in range(days) for i in range(5) for j in range(3)]
    late = [(10**6 + d, START + timedelta(days=d), "ip0", "k", "s", 0, 0) for d in (0, 4)]
    for d in range(days):
        part = [r for r in data if r[1].day == d + 1] + (late if d == days - 1 else [])
        spark.createDataFrame(part, REQUEST).coalesce(1).write.parquet(f"{folder}/in/{d}")
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    got, late_rows, progress = cap_stream(spark, source, folder, 2, 7)
    # Days before the watermark have left: counts, timers and their index of four days at most remain.
    totals = [p.stateOperators[0].numRowsTotal for p in progress]
    assert max(totals) <= 5 * 4 * 3 and totals[-1] <= totals[3]
    assert spark.read.parquet(f"{folder}/days").groupBy("batch").count().agg(F.max("count")).first()[0] <= 5
    assert [r["request_id"] for r in late_rows.collect()] == [10**6]
    twin = {tuple(r) for r in limits.cap_decisions(spark.createDataFrame(data, REQUEST), 2, 7).select(CAP_COLUMNS).collect()}
    mine = {tuple(r) for r in got.select(CAP_COLUMNS).collect()}
    # The request of day 4 that came two days later counts after those before it.
    assert twin < mine and mine - twin == {(10**6 + 4, 4, None, "ip-blocked")}


def test_latest_state(spark, rows, folder):
    got = drain(state.latest_30_state(stream_of(spark, rows, folder, 3), keep=30, days=90), folder, "out")
    newest = got.groupBy("site", "record_id").agg(F.max("_batch").alias("b"), F.max_by("hist_no", "_batch").alias("hist_no"))
    final = newest.where(F.col("b") == got.agg(F.max("_batch")).first()[0]).select("site", "record_id", "hist_no")
    twin = history.last_n_history(rows, ["site"], F.lit("2024-01-09").cast("timestamp"), 30, 90).select("site", "record_id", F.col("hist_no").cast("bigint"))
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, twin.collect()))


def test_counts_and_dedupe(spark, rows, folder):
    got = drain(counters.daily_counts(stream_of(spark, rows, folder)), folder, "out")
    assert sorted(map(tuple, got.select("day", "n").collect())) == sorted(map(tuple, limits.daily_counts(rows).collect()))
    deduped = drain(state.dedupe_within_24h(stream_of(spark, rows, folder + "/d")), folder, "dd", "append")
    assert deduped.select("cache_key").distinct().count() == 4 and deduped.count() < 120


def test_late_rows_are_dropped(spark, rows, folder):
    late = rows.limit(1).withColumn("ts", F.lit("2023-01-01").cast("timestamp"))
    stream_in = f"{folder}/in"
    rows.write.parquet(f"{stream_in}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 100).parquet(stream_in)
    drain(counters.daily_counts(source), folder, "one")
    late.write.mode("append").parquet(stream_in)
    again = drain(counters.daily_counts(source), folder, "one")
    assert again.where("day < date'2024-01-01'").count() == 0


PAGE = "<html><head><title>t</title></head><body><h1>x</h1><p>" + "본문 " * 400 + "</p></body></html>"
BETTER = PAGE.replace("</p>", " 전문의</p><time datetime='2026-01-01'>d</time>")
PAGES = "page_id bigint, url string, ts timestamp, html string"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run_audit(spark, folder, robots=False, **options):
    source = spark.readStream.schema(PAGES).parquet(f"{folder}/pages")
    answers = spark.readStream.schema(ANSWERS).parquet(f"{folder}/robots") if robots else None
    query = audit.stream_audit(source, f"{folder}/h", f"{folder}/cp", answers, **options).trigger(availableNow=True).start()
    assert query.awaitTermination(120), query.stop()
    return {r["page_id"]: r for r in spark.read.parquet(f"{folder}/h/score").collect()}


def test_stream_audit(spark, folder):
    """Two records of a domain in the first batch, none in the second, one in the third; the history before them as snapshot."""
    history = spark.createDataFrame([("a.co.kr", START - timedelta(days=n), n, 50 + n) for n in (1, 2, 3)], "domain string, ts timestamp, page_id bigint, score int")
    url = "https://www.a.co.kr/"
    for rows in [[(1, url, START + timedelta(days=1), BETTER), (0, url, START, PAGE)], [], [(2, url, START + timedelta(days=2), PAGE), (3, "https://b.co.kr/", START, PAGE)]]:
        put(spark, rows, PAGES, f"{folder}/pages")
        got = run_audit(spark, folder, snapshot=audit.newest(history))
    scores, deltas = {i: r["score"] for i, r in got.items()}, {i: r["delta"] for i, r in got.items()}
    assert len(got) == 4 and scores[1] > scores[0] == scores[2]
    assert deltas == {0: scores[0] - 51, 1: scores[1] - scores[0], 2: scores[2] - scores[1], 3: None}


ANSWERS = "host string, ts timestamp, status int, content_type string, body string"


def test_robots_answers_join_pages(spark, folder):
    def at(hours, minutes=0):
        return START + timedelta(hours=hours, minutes=minutes)

    def answer(host, when, status=200, body="User-agent: *\nDisallow: /"):
        return host, when, status, "text/plain", body

    put(spark, [(1, "https://a.kr/", at(1, 5), PAGE), (2, "https://b.kr/", at(1, 6), PAGE), (3, "https://c.kr/", at(1, 7), PAGE)], PAGES, f"{folder}/pages")
    # The second answer of a host and hour doesn't count; one of the hour before doesn't either.
    put(spark, [answer("a.kr", at(1)), answer("b.kr", at(1, 1), 404), answer("c.kr", at(0, 59))], ANSWERS, f"{folder}/robots")
    first = run_audit(spark, folder, robots=True)
    assert {i: r["crawl"] for i, r in first.items()} == {1: "fail", 2: "warn"}
    put(spark, [(4, "https://a.kr/", at(1, 40), PAGE)], PAGES, f"{folder}/pages")
    put(spark, [answer("a.kr", at(1, 30), body="")], ANSWERS, f"{folder}/robots")
    assert run_audit(spark, folder, robots=True)[4]["crawl"] == "fail"
    # Time moves on: the page without an answer leaves as absent, and the domain's last record still stands.
    put(spark, [(5, "https://a.kr/", at(9), BETTER)], PAGES, f"{folder}/pages")
    put(spark, [answer("a.kr", at(9), body="User-agent: *\nAllow: /")], ANSWERS, f"{folder}/robots")
    got = run_audit(spark, folder, robots=True)
    assert {i: r["crawl"] for i, r in got.items()} == {1: "fail", 2: "warn", 3: "warn", 4: "fail", 5: "ok"}
    assert got[4]["delta"] == 0 and got[5]["prev_score"] == got[4]["score"] and got[3]["prev_score"] is None


def test_late_rows_are_counted(spark, rows, folder):
    listener = LateRows(limit=1)
    spark.streams.addListener(listener)
    try:
        rows.write.parquet(f"{folder}/in/0")
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        drain(counters.daily_counts(source), folder, "one")
        old = spark.createDataFrame([(9, datetime(2023, 1, d), "ip", "k", "s", 9, 9) for d in (1, 1, 2)], REQUEST)
        old.coalesce(1).write.parquet(f"{folder}/in/1")
        query = counters.daily_counts(source).writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/one-cp").queryName("days").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        # Two days, three rows: rows of one task and day are summed before the watermark is asked.
        assert dropped_so_far(query) == 2
        for _ in range(50):
            if listener.of("days"):
                break
            time.sleep(0.2)
        assert listener.of("days") == 2 and listener.over == {"days"} and listener.of("other") == 0
    finally:
        spark.streams.removeListener(listener)


def test_chained_panel(spark, folder):
    """Prompts first, engines over prompts: the windows that are closed equal the batch panel."""
    rnd = random.Random(1)
    schema = "site string, engine string, prompt string, ts timestamp, status string, cited boolean, named boolean"
    data = [
        (f"s{rnd.randrange(2)}", "chatgpt", f"p{rnd.randrange(4)}", START + timedelta(hours=i), rnd.choice(["valid"] * 4 + ["error"]), i % 3 == 0, False)
        for i in range(24 * 40)
    ]
    for k in range(4):
        put(spark, data[k * 240 : (k + 1) * 240], schema, f"{folder}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = drain(counters.closed_panel(source, ["site"], window="7 days"), folder, "out", "append")
    columns = ["site", "engine", "attempts", "valid_runs", "cited_runs", "errored_runs", "prompts_scored", "always_cited", "never_cited", "sometimes_cited", "spread"]
    batch = spark.createDataFrame(data, schema).withColumn("window_start", F.window("ts", "7 days").start)
    twin = citation_panel(batch, ["site", "window_start"]).where(F.col("window_start") < F.lit(START + timedelta(days=29)))
    assert got.count() == twin.count() >= 8
    assert sorted(str(r) for r in got.select(columns).collect()) == sorted(str(r) for r in twin.select(columns).collect())


def test_latest_state_orders_by_microseconds(spark, folder):
    data = [(i, START + timedelta(microseconds=us), "ip", "k", "s", i, 0) for i, us in ((9, 1), (1, 2), (5, 2000))]
    rows = spark.createDataFrame(data, REQUEST)
    got = drain(state.latest_30_state(stream_of(spark, rows, folder), keep=2, days=90), folder, "out").collect()
    assert sorted((r["hist_no"], r["record_id"]) for r in got) == [(1, 5), (2, 1)]


def test_caps_call_python_once_a_bucket(spark, folder):
    """State and calls go with the buckets of a day, and every value comes back as it was."""
    big = 2**60 + 1
    data = [(i, START + timedelta(microseconds=i), None if i % 300 == 0 else f"ip{i % 300}", float("nan") if i % 2 else None, big if i % 3 else None) for i in range(900)]
    rows = spark.createDataFrame(data, "request_id bigint, ts timestamp, ip_hash string, x double, n bigint")
    got, _, progress = cap_stream(spark, stream_of(spark, rows, folder), folder, 2, 0)
    assert max(p.stateOperators[0].numRowsTotal for p in progress) < 300
    assert sorted(map(str, got.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    twin = limits.cap_decisions(rows, 2, 0).select(CAP_COLUMNS)
    assert sorted(map(str, got.select(CAP_COLUMNS).collect())) == sorted(map(str, twin.collect()))


def test_reuse_returns_rows_as_they_were(spark, folder):
    data = [(i, START + timedelta(hours=i, microseconds=i), "k", None if i % 2 else 2**60 + i) for i in range(60)]
    rows = spark.createDataFrame(data, "request_id bigint, ts timestamp, cache_key string, n bigint")
    got, _ = written(spark, decisions.reuse_decisions(stream_of(spark, rows, folder)), folder)
    assert sorted(map(str, got.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    twin = limits.reuse_decisions(rows).select("request_id", "decision")
    assert sorted(map(tuple, got.select("request_id", "decision").collect())) == sorted(map(tuple, twin.collect()))
