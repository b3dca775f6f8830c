"""Listings, funnel, readers, sinks, history, limits, planning."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citescope.functions import ordered
from citescope.functions.stats import one_decimal
from citescope.operators import funnel, history, limits, measurement, notes, places
from citescope.sources import dimensions, readers, sinks


def test_ordered_helpers_match_plain_windows(spark):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.05 else ("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}"), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 9)), i, i % 7)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id bigint, v bigint")
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("ts", "id")
    plain = {r["id"]: (r["n"], r["p"]) for r in df.select("id", F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("p")).collect()}
    cut = F.date_trunc("day", F.col("ts"))
    numbered = ordered.group_row_number(df, ["k"], ["ts", "id"], cut, "n")
    both = ordered.group_lag(numbered, ["k"], ["ts", "id"], cut, {"p": "v"})
    assert {r["id"]: (r["n"], r["p"]) for r in both.collect()} == plain


def test_match_target_cases(spark):
    cases = [
        ([("a", "우리치과의원", "02-111-2222"), ("b", "강남플란트치과", "02-333-4444"), ("c", "목동치과의원", None)], "02-111-2222", None, "a"),
        ([("a", "우리치과의원", "02-111-2222")], "(031) 1112222", None, "a"),
        ([("a", "우리치과의원", None), ("b", "강남플란트치과", None)], None, "플란트", "b"),
        ([("x", "닥터재일치과의원", None), ("y", "트리움치과의원", None)], None, "둔촌동 트리움치과", "y"),
        ([("s", "시그니처치과교정과치과의원", None)], None, "시그니처치과", "s"),
        ([("f", "강남서울미소치과의원", None), ("e", "서울미소치과의원", None)], None, "서울미소치과", "e"),
        ([("z", "치과의원", None)], None, "둔촌동 트리움치과", None),
        ([("a", "우리치과의원", "02-111-2222")], "000-000-0000", "없는치과", None),
    ]
    listing = [(q, i + 1, *p) for q, (ps, _, _, _) in enumerate(cases) for i, p in enumerate(ps)]
    asked = [(q, f"s{q}", phone, name) for q, (_, phone, name, _) in enumerate(cases)]
    pdf = spark.createDataFrame(listing, "query int, rank int, place_id string, name string, phone string")
    sdf = spark.createDataFrame(asked, "query int, site string, phone string, name string")
    got = {r["query"]: r["place_id"] for r in places.match_target(pdf, sdf).collect()}
    assert [got.get(q) for q in range(len(cases))] == [c[3] for c in cases]


def test_match_target_against_brute_force(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("가나다") for _ in range(rng.randrange(1, 5))) + rng.choice(["치과", "의원", ""])
    phone = lambda: rng.choice([None, f"02-{rng.randrange(3):03d}-{rng.randrange(3):04d}", f"031{rng.randrange(3):03d}{rng.randrange(3):04d}"])
    listing = [(0 if rng.random() < 0.5 else rng.randrange(4), i, f"p{i}", name(), phone()) for i in range(120)]
    asked = [(rng.randrange(4), f"s{i}", phone(), name()) for i in range(60)]
    suffixes = "치과의원 치과병원 교정과 한의원 클리닉 덴탈 치과 병원 의원".split()

    def core(raw):
        norm = raw.strip().lower().replace(" ", "")
        c, again = norm, True
        while again and len(c) >= 2:
            again = False
            for s in suffixes:
                if c.endswith(s):
                    c, again = c[: -len(s)], True
                    break
        return c if len(c) >= 2 else norm

    digits = lambda p: "".join(ch for ch in p or "" if ch.isdigit())
    expected = {}
    for q, site, ph, nm in asked:
        rows = sorted(r for r in listing if r[0] == q)
        want, wc = digits(ph), core(nm)
        tests = [lambda r: len(want) >= 7 and r[4] and digits(r[4]) == want,
                 lambda r: len(want) >= 7 and r[4] and digits(r[4]).endswith(want[-7:]),
                 lambda r: len(wc) >= 2 and len(core(r[3])) >= 2 and core(r[3]) == wc,
                 lambda r: len(wc) >= 2 and len(core(r[3])) >= 2 and (wc in core(r[3]) or core(r[3]) in wc)]
        for test in tests:
            hit = next((r for r in rows if test(r)), None)
            if hit:
                expected[site] = hit[2]
                break
    pdf = spark.createDataFrame(listing, "query int, rank int, place_id string, name string, phone string")
    sdf = spark.createDataFrame(asked, "query int, site string, phone string, name string")
    assert {r["site"]: r["place_id"] for r in places.match_target(pdf, sdf).collect()} == expected


def test_parse_count(spark):
    values = ["2,203", "51", "0", None, "N/A", "", " 12abc"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r["n"] for r in df.select("i", places.parse_count("v").alias("n")).orderBy("i").collect()] == [2203, 51, 0, None, None, None, 12]


def test_review_gap_rounds_the_exact_ratio(spark):
    # 2869 / 20 is a little under 143.45, 6396 / 624 is exactly 10.25, 1999999 / 100000 carries.
    cases = [(20, 2869, "143.4"), (624, 6396, "10.3"), (20, 23, "1.1"), (4, 7, "1.8"), (100000, 1999999, "20.0"), (3, 10**15, "333333333333333.3")]
    df = spark.createDataFrame([(i, m, t) for i, (m, t, _) in enumerate(cases)], "i int, m bigint, t bigint")
    got = df.orderBy("i").select(places.review_gap(F.col("m"), F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [f"격차 ×{x}" for _, _, x in cases]
    tiny = spark.createDataFrame([(0.05,), (0.04,), (0.0,), (0.95,), (0.25,)], "x double")
    assert [r["s"] for r in tiny.select(one_decimal("x").alias("s")).collect()] == ["0.1", "0.0", "0.0", "0.9", "0.3"]


def test_readers(spark, folder):
    def put(name, value):
        with open(f"{folder}/{name}", "w") as f:
            f.write(value if isinstance(value, str) else json.dumps(value))
        return f"{folder}/{name}"

    row = lambda s, d, *m: {"dimensionValues": [{"value": s}, {"value": d}], "metricValues": [{"value": x} for x in m]}
    path = put("ga.json", {"rows": [row("chatgpt.com / ai-assistant", "20260620", "10", "8", "2"), row("chatgpt.com / ai-assistant", "20260621", "5", "4", "1"),
                                    row("perplexity.ai / ai-assistant", "20260621", "3", "3", "0"), row("google / organic", "20260621", "99", "9", "9")]})
    rows = {r["source_medium"]: r for r in funnel.ai_sessions_by_platform(readers.read_ai_sessions(spark, path)).collect()}
    assert rows[None]["sessions"] == 18 and rows[None]["key_events"] == 3 and rows["chatgpt.com / ai-assistant"]["sessions"] == 15

    group = lambda n, ids, ua=None: {"count": n, "dimensions": {"botDetectionIds": ids, "clientRequestPath": "/", "userAgent": ua}}
    groups = [group(12, [126255384]), group(7, [33563889, 1]), group(3, [999]), group(2, [5, 33563859], "x PerplexityBot y GPTBot")]
    path = put("cf.json", {"data": {"viewer": {"zones": [{"httpRequestsAdaptiveGroups": groups}]}}})
    hits = funnel.bot_hits_by_bot(readers.read_bot_hits(spark, path))
    assert {r["bot"]: r["hits"] for r in hits.collect()} == {"OAI-SearchBot": 12, "PerplexityBot": 7, "id:999": 3, "ClaudeBot": 2}
    assert funnel.search_bots_crawling(hits).first()["total"] == 24
    by_agent = funnel.bot_hits_by_bot(readers.read_bot_hits(spark, path, "ua"), mode="ua")
    assert {r["bot"]: r["hits"] for r in by_agent.collect()} == {"(ua)": 22, "PerplexityBot": 2}

    item = {"id": "1", "name": "우리치과", "x": "127.02", "y": "37.5", "visitorReviewCount": "1,200", "imageCount": 5}
    path = put("place.json", {"query": "q", "start": 31, "total": 655, "items": [item, {"id": "2", "name": "b"}]})
    got = readers.read_place_results(spark, path).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [31, 32] and got[0]["visitor_reviews"] == 1200 and got[0]["coords"]["lng"] == 127.02 and got[1]["coords"] is None

    path = put("feed.xml", "<rss><channel><item><title> ChatGPT news </title><link>https://a/</link><pubDate>d</pubDate></item>"
               "<item><title>other</title><link>https://b/</link></item></channel></rss>")
    put("atom.xml", '<feed><entry><title>AI overview</title><link href="https://c/"/><updated>u</updated></entry></feed>')
    assert [r["url"] for r in notes.feed_candidates(readers.read_feed_items(spark, path, "f")).collect()] == ["https://a/"]
    assert readers.read_feed_items(spark, f"{folder}/atom.xml", "g").first()["url"] == "https://c/"

    note = {"title": "t", "url": "https://x", "summary": "s", "confidence": "sure"}
    path = put("notes.json", {"reviewedAt": "2026-06-29", "notes": [note, {**note, "url": "ftp://x"}], "benchmarks": [{"label": "l", "metric": "m"}, {"label": "l"}]})
    found, marks = readers.read_field_notes(spark, path)
    assert [r["confidence"] for r in notes.valid_notes(found).collect()] == ["medium"] and notes.valid_benchmarks(marks).count() == 1
    stale = lambda day: found.select(history.is_stale("reviewed_at", F.lit(day).cast("timestamp")).alias("x")).first()["x"]
    assert stale("2026-07-20") is False and stale("2026-07-21") is True

    put("page.html", "<title>t</title>")
    assert readers.read_pages(spark, f"{folder}/page.html", "text").first()["html"] == "<title>t</title>"
    path = put("robots.json", {"host": "h", "status": 200, "content_type": "text/plain", "body": "User-agent: *\nDisallow: /\n"})
    assert readers.read_robots(spark, path).first()["status"] == 200


def test_sinks(spark, folder):
    first = spark.sql("select 'a' domain, '2026-01' period, 1 n, timestamp'2026-01-05' saved_at union all select 'a', '2026-02', 2, timestamp'2026-02-05'")
    sinks.upsert_monthly(first, f"{folder}/m")
    sinks.upsert_monthly(spark.sql("select 'a' domain, '2026-02' period, 9 n, timestamp'2026-02-06' saved_at"), f"{folder}/m")
    sinks.upsert_monthly(spark.sql("select 'a' domain, '2026-02' period, 5 n, timestamp'2026-02-01' saved_at"), f"{folder}/m")
    rows = {r["period"]: r["n"] for r in sinks.read_monthly(spark, f"{folder}/m").collect()}
    assert rows == {"2026-01": 1, "2026-02": 9}

    with pytest.raises(ValueError, match="n: int stored"):
        sinks.upsert_monthly(spark.sql("select 'a' domain, '2026-02' period, 'x' n, timestamp'2026-02-09' saved_at"), f"{folder}/m")
    assert {r["period"]: r["n"] for r in sinks.read_monthly(spark, f"{folder}/m").collect()} == rows

    record = spark.sql("select 'a' domain, 50 score, timestamp'2026-01-05' ts")
    sinks.append_history(record, folder, "score")
    sinks.append_history(record.withColumn("ts", F.lit("2026-03-05").cast("timestamp")), folder, "score")
    assert sinks.read_history(spark, folder, "score", F.lit("2026-02-01").cast("date")).count() == 1

    leads = spark.createDataFrame(
        [("", "d.kr", "c" * 150, "kim", "010", "a@b.c", ["p"], "n", 1.0, True), ("public", "", "clinic", None, "", "bad", None, "hello", None, None),
         ("public", "", "clinic", None, "", "a@b.c", None, "hello", None, None), ("", "", "c", "", "1", "", ["p"], "", None, None), ("", "", " ", "k", "1", "", ["p"], "", None, None)],
        "source string, domain string, clinic_name string, contact_name string, phone string, email string, selected_products array<string>, notes string, geo_score double, ai_cited boolean")
    sinks.append_leads(leads, f"{folder}/leads", F.lit("2026-01-05").cast("timestamp"))
    good = spark.read.parquet(f"{folder}/leads/accepted").orderBy("contact_name").collect()
    assert {len(r["clinic_name"]) for r in good} == {100, 6} and {r["phone"] for r in good} == {"010", "-"} and all(r["status"] == "신규" for r in good)
    assert sorted(r["reject_reason"] for r in spark.read.parquet(f"{folder}/leads/rejected").collect()) == ["invalid-email", "missing-clinicName", "missing-contactName"]


def test_reuse_matches_a_plain_fold(spark):
    rng = random.Random(11)
    rows = [(f"k{0 if rng.random() < 0.4 else rng.randrange(6)}", datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(86400 * 6)), i) for i in range(800)]
    df = spark.createDataFrame(rows, "cache_key string, ts timestamp, request_id bigint")
    expected, until = {}, {}
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        fresh = key not in until or ts > until[key]
        if fresh:
            until[key] = ts + timedelta(hours=24)
        expected[i] = "run" if fresh else "reuse"
    assert {r["request_id"]: r["decision"] for r in limits.reuse_decisions(df).collect()} == expected


def test_numbers_share_their_input(spark, folder):
    spark.sql("select id request_id, 'a' ip_hash, timestamp'2024-01-01' + make_interval(0,0,0,0,0,int(id),0) ts from range(5)").write.parquet(f"{folder}/r")
    decided = limits.cap_decisions(spark.read.parquet(f"{folder}/r"), 2, 2)
    decided.collect()
    text = decided._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("FileScan") <= 3 and "ReusedExchange" in final


def test_caps_with_one_key_holding_most_rows(spark):
    rng = random.Random(4)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(86400 * 2)), "hot" if rng.random() < 0.9 else f"a{rng.randrange(5)}") for i in range(1500)]
    df = spark.createDataFrame(rows, "request_id bigint, ts timestamp, ip_hash string")
    expected, seen, passed = {}, {}, {}
    for i, ts, ip in sorted(rows, key=lambda r: (r[1], r[0])):
        n = seen[ts.date(), ip] = seen.get((ts.date(), ip), 0) + 1
        if n > 400:
            expected[i] = "ip-blocked"
            continue
        m = passed[ts.date()] = passed.get(ts.date(), 0) + 1
        expected[i] = "global-blocked" if m > 450 else "allowed"
    assert {r["request_id"]: r["decision"] for r in limits.cap_decisions(df, 400, 450).collect()} == expected


def test_lead_limit(spark):
    rows = [(i, datetime(2024, 1, 1, 9) + timedelta(minutes=i), "a" if i % 4 else None) for i in range(90)]
    got = sinks.limit_leads(spark.createDataFrame(rows, "request_id bigint, ts timestamp, ip_hash string")).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["ts"]):
        key = (r["ts"].hour, r["ip_hash"])
        seen[key] = seen.get(key, 0) + 1
        assert r["rate_limited"] == (seen[key] > 5)


def test_caps_off(spark):
    df = spark.sql("select id request_id, 'a' ip_hash, timestamp'2024-01-01' + make_interval(0,0,0,0,0,int(id),0) ts from range(5)")
    assert {r["decision"] for r in limits.cap_decisions(df, 0, 0).collect()} == {"allowed"}
    got = [r["decision"] for r in limits.cap_decisions(df, 3, 2).orderBy("request_id").collect()]
    assert got == ["allowed", "allowed", "global-blocked", "ip-blocked", "ip-blocked"]


def test_planning(spark):
    row = spark.sql("select ' 강남 ' district, '임플란트' procedure, '' business_type, array('2','9','2','x') query_indexes, array('q') queries, array('b','a','b',' ') regions, 'x' region, 9 n")
    assert len(measurement.query_variants(row).collect()) == 9
    r = measurement.select_prompts(row).select("prompts", "query_fp", measurement.normalize_regions("regions", "region").alias("rs"), measurement.clamp_repeats("n").alias("n")).first()
    assert r["prompts"] == ["강남 치과 추천"] and r["query_fp"] == "indexes:2" and r["rs"] == ["b", "a"] and r["n"] == 3
    request = measurement.request_json(F.lit("chatgpt"), F.lit("s"), F.lit("u"), F.lit("강남"))
    body = json.loads(row.select(request.alias("r")).first()["r"])
    assert body["tool_choice"] == "required" and body["tools"][0]["user_location"]["city"] == "강남" and body["input"][1]["content"] == "u"


def test_dimensions(spark):
    assert dimensions.dim_bot(spark).count() == 18 and dimensions.dim_engine(spark).where("measure_mode = 'auto-api'").count() == 3
    assert dimensions.dim_sido(spark).count() == 45 and dimensions.dim_procedure(spark).count() == 14
    assert dimensions.dim_checklist(spark).count() == 25 and dimensions.dim_region_term(spark).count() > 60
    assert dimensions.dim_score_item(spark).agg(F.sum("max")).first()[0] == 100 and dimensions.dim_follow_up(spark).count() == 9
    assert dimensions.dim_bot_detection(spark).count() == 11
