"""Suffix rules, compacted histories, mergeable counts, feed order."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citescope.functions import suffixes
from citescope.operators import history, notes, reach, signals
from citescope.sources import history_store, readers, sinks

RULES = """// ===BEGIN ICANN DOMAINS===
com
uk
co.uk
*.ck
!www.ck
jp
*.kawasaki.jp
!city.kawasaki.jp
한국
香港
個人.香港
// ===BEGIN PRIVATE DOMAINS===
blogspot.com
// ===END PRIVATE DOMAINS===
"""


@pytest.fixture(scope="module")
def rule_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "list.dat"
    path.write_text(RULES, encoding="utf-8")
    return str(path)


CASES = [
    ("https://www.example.com/a?b", "example.com"), ("example.com", "example.com"), ("com", "com"), ("http://a.b.example.co.uk:80/", "example.co.uk"),
    ("co.uk", "co.uk"), ("x.uk", "x.uk"), ("b.test.ck", "b.test.ck"), ("a.b.test.ck", "b.test.ck"), ("test.ck", "test.ck"),
    ("www.ck", "www.ck"), ("x.y.www.ck", "www.ck"), ("city.kawasaki.jp", "city.kawasaki.jp"), ("a.city.kawasaki.jp", "city.kawasaki.jp"),
    ("c.kobe.kawasaki.jp", "c.kobe.kawasaki.jp"), ("kobe.kawasaki.jp", "kobe.kawasaki.jp"), ("a.b.kobe.kawasaki.jp", "b.kobe.kawasaki.jp"),
    ("www.unknown.tld", "unknown.tld"), ("localhost", "localhost"), ("192.168.0.1", "192.168.0.1"), ("http://[::1]/x", "[::1]"),
    ("a.blogspot.com", "blogspot.com"), ("https://병원.예시.한국/", "xn--vv4bn7u.xn--3e0b707e"), ("xn--vv4bn7u.xn--3e0b707e", "xn--vv4bn7u.xn--3e0b707e"),
    ("a.b.個人.香港", "b.xn--gmqw5a.xn--j6w193g"), ("", ""), (None, ""), ("www.", "www."),
]


def test_suffix_rules(spark, rule_file):
    rules = suffixes.read_suffix_rules(spark, rule_file)
    rows = spark.createDataFrame([(i, u, "x") for i, (u, _) in enumerate(CASES)], "i int, u string, domain string")
    found = suffixes.with_registrable_domain(rows, "u", rules)
    got = {r["i"]: r["domain"] for r in found.collect()}
    expected = {i: d for i, (_, d) in enumerate(CASES)}
    expected[21] = expected[22] = ".".join(x.encode("idna").decode() for x in ("예시", "한국"))
    rows_by_text = {i: u for i, (u, _) in enumerate(CASES)}
    got[22], expected[22] = None, None  # an encoded host is looked at below
    assert {rows_by_text[i]: d for i, d in got.items()} == {rows_by_text[i]: d for i, d in expected.items()}
    assert found.columns == ["i", "u", "domain"]
    with_private = suffixes.read_suffix_rules(spark, rule_file, private=True)
    one = suffixes.with_registrable_domain(rows.where("i = 20"), "u", with_private).first()
    assert one["domain"] == "a.blogspot.com"


def test_international_hosts(spark, rule_file):
    coded = "병원.예시.한국".encode("idna").decode()
    rows = spark.createDataFrame([(0, f"https://{coded}/"), (1, "https://병원.예시.한국/x"), (2, "xn--zzzzzz99999.com"), (3, "한" * 80 + ".com")], "i int, u string")
    rules = suffixes.read_suffix_rules(spark, rule_file)
    got = {r["i"]: r["domain"] for r in suffixes.with_registrable_domain(rows, "u", rules, readable=True).collect()}
    # What cannot be decoded or encoded stays as it is.
    assert got[0] == got[1] == "예시.한국" and got[2] == "xn--zzzzzz99999.com" and got[3] == "한" * 80 + ".com"


def records(n, seed=1):
    rnd = random.Random(seed)
    return [(f"d{0 if i % 3 == 0 else rnd.randrange(20)}", i, rnd.randrange(100), datetime(2025, 1, 1) + timedelta(hours=7 * i)) for i in range(n)]


def test_compacted_history(spark, folder):
    schema = "domain string, record_id long, score int, ts timestamp"
    table = "history_" + folder.rsplit("/", 1)[-1].replace("-", "_")
    rows = spark.createDataFrame(records(600), schema)
    sinks.append_history(rows.where("ts < '2025-03-10'"), folder, "score")
    assert history_store.compact_history(spark, folder, "score", table, F.lit(date(2025, 3, 1)), buckets=4) == ["2025-01", "2025-02"]
    # March is not closed; a run that died left files without a mark.
    sinks.append_history(rows.where("ts >= '2025-03-10'"), folder, "score")
    spark.sql("select 'half' domain, 1L record_id, 1 score, timestamp'2025-03-01' ts, date'2025-03-01' day").write.parquet(f"{folder}/score-buckets/month=2025-03")
    assert history_store.compact_history(spark, folder, "score", table, F.lit(date(2025, 6, 1)), buckets=4) == ["2025-03", "2025-04", "2025-05"]
    assert history_store.compact_history(spark, folder, "score", table, F.lit(date(2025, 6, 1)), buckets=4) == []
    moved = history_store.compacted_history(spark, folder, "score", table)
    closed = rows.where("ts < '2025-06-01'")
    assert sorted(map(tuple, moved.select(rows.columns).collect())) == sorted(map(tuple, closed.collect()))

    now = F.lit(datetime(2025, 6, 1))
    newest = history.last_n_history(moved, ["domain"], now, 5, 90, tiebreak=["record_id"])
    deltas = history.score_delta(moved, ["domain"], tiebreak=["record_id"], slice_unit=None)
    for df in (newest, deltas):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Bucketed: true" in text
    columns = ["domain", "record_id", "prev_score", "delta", "direction"]
    sliced = history.score_delta(closed, ["domain"], tiebreak=["record_id"])
    assert sorted(str(r) for r in deltas.select(columns).collect()) == sorted(str(r) for r in sliced.select(columns).collect())
    twin = history.last_n_history(closed, ["domain"], now, 5, 90, tiebreak=["record_id"]).select("domain", "record_id", "hist_no")
    assert sorted(map(tuple, newest.select("domain", "record_id", "hist_no").collect())) == sorted(map(tuple, twin.collect()))

    pruned = history_store.compacted_history(spark, folder, "score", table, F.lit(date(2025, 5, 20)))
    assert pruned.count() == closed.where("ts >= '2025-05-20'").count()
    assert history_store.drop_compacted_days(spark, folder, "score") > 100
    assert moved.count() == closed.count() and sinks.read_history(spark, folder, "score").count() == rows.count() - closed.count()
    spark.sql(f"drop table {table}")


def test_reach_merges_days(spark):
    """A window is the union of its days; the error stays within the sketch's bound."""
    rows = spark.range(60_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('s', id % 5)) site", "'chatgpt' engine", "if(id % 10 = 0, 'error', 'valid') status",
        "timestamp_seconds(1704067200 + (id % 40) * 86400) ts", "array(concat('d', (id * 7919) % 20000), concat('d', id % 300)) cited_domains",
    )
    days = reach.daily_reach(rows, ["site"])
    assert days.count() == rows.where("status = 'valid'").select("site", F.to_date("ts")).distinct().count()
    for since, until in ((None, None), ("2024-01-05", "2024-01-12")):
        low, high = (F.lit(x).cast("date") if x else None for x in (since, until))
        part = rows if since is None else rows.where((F.col("ts") >= since) & (F.col("ts") < until))
        about = {r["site"]: r for r in reach.reach(days, ["site"], low, high).collect()}
        exact = {r["site"]: r["exact_domains"] for r in reach.exact_reach(part, ["site"]).collect()}
        assert about.keys() == exact.keys()
        # Four standard errors of lg_k = 14.
        assert all(abs(about[s]["domains"] - n) <= max(1, n * 4 * 1.04 / 128) for s, n in exact.items())
        assert sum(r["valid_runs"] for r in about.values()) == part.where("status = 'valid'").count()


def test_feed_order_is_the_files(spark, folder):
    def feed(items):
        return "<rss><channel>\n" + "\n".join(items) + "\n</channel></rss>"

    items = [f"<item><title>AI Search {i} &amp; more</title><link>https://f/{i}</link><pubDate>d{i}</pubDate></item>" for i in range(40)]
    entries = [f'<entry xml:lang="en"><title>Gemini {i}</title><link rel="self" href="https://x/"/><link href="https://g/{i}"/><updated>u</updated></entry>' for i in range(3)]
    for name, body in (("a.xml", feed(items[:25])), ("b.xml", feed([*items[25:], "<item><title> </title><link>https://e</link></item>"])), ("c.xml", "<feed>" + "".join(entries) + "</feed>")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(body)
    rows = readers.read_feed_items(spark, f"{folder}/*.xml", "f")
    got = [(r["url"], r["title"], r["item_no"]) for r in rows.orderBy("file", "item_no").collect()]
    assert got == [
        *[(f"https://f/{i}", f"AI Search {i} & more", i if i < 25 else i - 25) for i in range(40)], *[(f"https://g/{i}", f"Gemini {i}", i) for i in range(3)]
    ]
    for parts in (1, 7):
        six = notes.feed_candidates(rows.repartition(parts)).orderBy("candidate_no").collect()
        assert [r["url"] for r in six] == [f"https://f/{i}" for i in range(6)]


def test_answer_first(spark):
    pad = "x" * 90
    rows = [("AI는 " + pad, False), ("AI는X " + pad, True), ("a은b", False), (pad * 2 + "y" * 58 + "a가b", False), (pad * 2 + "y" * 57 + "a가b", True), (None, False), ("_란_" + pad, True), ("é이é" + pad, False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r["x"] for r in df.select("i", signals.answer_first("t").alias("x")).orderBy("i").collect()] == [x for _, x in rows]
