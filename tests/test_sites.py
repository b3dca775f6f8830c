"""URLs, addresses, robots and headers, table-driven."""

from pyspark.sql import functions as F

from citescope.functions import net, urls
from citescope.operators import robots


def _column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_registrable_domain(spark):
    cases = {
        "https://www.haru.co.kr/implant": "haru.co.kr", "clinic.or.kr": "clinic.or.kr", "HTTP://WWW.Example.COM/": "example.com",
        "sub.example.com": "example.com", "co.kr": "co.kr", "localhost": "localhost", "http://10.0.0.1/x": "10.0.0.1", "": "",
        "https://user:pw@a.b.example.org:8443/p?q#f": "example.org", "https://ex ample.com/": "https://ex ample.com/",
        "a.b.c.co.uk": "c.co.uk",
    }
    assert _column(spark, list(cases), urls.registrable_domain) == list(cases.values())


def test_unwrap_and_match(spark):
    wrapped = "https://vertexaisearch.cloud.google.com/grounding-api-redirect/abc?url=https%3A%2F%2Fharu.co.kr%2F"
    links = [wrapped, "https://haru.co.kr/x", "https://www.bing.com/ck/a?u=a1&r=http%3A%2F%2Fb.example%2F%3Fx%3D1", "not a url"]
    assert _column(spark, links, urls.unwrap_redirect) == ["https://haru.co.kr/", links[1], "http://b.example/?x=1", "not a url"]
    target = urls.registrable_domain(F.lit("haru.co.kr"))
    assert _column(spark, links, lambda u: urls.same_site(u, target)) == [True, True, False, False]


def test_url_problem(spark):
    cases = {
        "https://ok.example/a": None, "": "missing-url", "ftp://x.example": "bad-scheme", "https://x.example:8080/": "bad-port",
        "https://x.example:443/": None, "http://u:p@x.example/": "userinfo-not-allowed", "no-scheme": "invalid-url",
        "https://blog.naver.com/x": "platform-url", "https://x.example/" + "a" * 2048: "url-too-long", "https:///": "invalid-url",
        "http://x.example:99999/": "invalid-url",
    }
    assert _column(spark, list(cases), urls.url_problem) == list(cases.values())


def test_ip_scope(spark):
    cases = {
        "8.8.8.8": "public", "169.254.169.254": "blocked-range-v4", "10.1.2.3": "blocked-range-v4", "172.32.0.1": "public",
        "255.255.255.255": "blocked-range-v4", "::1": "blocked-range-v6", "::": "blocked-range-v6", "fd00::1": "blocked-range-v6",
        "fe80::1": "blocked-range-v6", "2606:4700::1111": "public", "::ffff:169.254.169.254": "blocked-range-v4", "::ffff:8.8.8.8": "public",
        "::ffff:a9fe:a9fe": "ipv4-mapped-v6-hex", "64:ff9b::808:808": "blocked-range-v6", "2002::1": "blocked-range-v6",
        "64:ff9b::8.8.8.8": "blocked-range-v6", "not-an-ip": "invalid-ip", "1.2.3": "invalid-ip", "256.1.1.1": "invalid-ip", "1::2::3": "invalid-ip",
    }
    assert _column(spark, list(cases), net.ip_scope) == list(cases.values())


def test_embeddable(spark):
    cases = [{}, {"X-Frame-Options": "DENY"}, {"content-security-policy": "frame-ancestors *"}, {"CSP": "x"},
             {"Content-Security-Policy": "frame-ancestors 'none'"}, {"content-security-policy": "default-src 'self'"}]
    assert _column(spark, cases, urls.embeddable, "map<string,string>") == [True, False, True, True, False, True]


ROBOTS = [
    ("<!doctype html><html></html>", 200, "text/html", dict(present=False, blocks_any=False)),
    ("Not Found", 404, "text/plain", dict(present=False)),
    ("User-agent: *\nAllow: /\nSitemap: https://x.co.kr/s.xml", 200, "text/plain", dict(present=True, blocks_any=False, sitemap="https://x.co.kr/s.xml")),
    ("User-agent: OAI-SearchBot\nDisallow: /\n\nUser-agent: *\nAllow: /\n", 200, "", dict(blocks_any=True, blocked_citation=["OAI-SearchBot"])),
    ("User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nAllow: /\n", 200, "", dict(blocks_any=False, blocked_training=["GPTBot"])),
    ("User-agent: bot\nDisallow: /\n", 200, "", dict(blocks_any=False, blocked_bots=[])),
    ("User-agent: OAI-SearchBot\nDisallow: /*\n", 200, "", dict(blocks_any=True)),
    ("User-agent: *\nDisallow: /admin/\n", 200, "", dict(blocks_any=False, partial_blocks=[])),
    ("User-agent: *\nDisallow:\n", 200, "", dict(blocks_any=False)),
    ("User-agent: OAI-SearchBot\nDisallow: /blog/\n", 200, "", dict(blocks_any=False, partial_blocks=[("OAI-SearchBot", ["/blog/"])])),
]


def test_robots_summary(spark):
    rows = [(str(i), s, c, b) for i, (b, s, c, _) in enumerate(ROBOTS)]
    df = spark.createDataFrame(rows, "host string, status int, content_type string, body string")
    for r in robots.robots_summary(df).collect():
        for name, expected in ROBOTS[int(r["host"])][3].items():
            value = r[name]
            if name == "partial_blocks":
                value = [(p["bot"], p["paths"]) for p in value]
            assert value == expected, (r["host"], name)


def test_path_allowed(spark):
    body = "User-agent: *\nDisallow: /\nAllow: /clinic/\nDisallow: /x$\nUser-agent: GPTBot\nDisallow: /a.b\n"
    files = spark.createDataFrame([("h", 200, "text/plain", body)], "host string, status int, content_type string, body string")
    asked = spark.createDataFrame(
        [("h", "OAI-SearchBot", "/"), ("h", "OAI-SearchBot", "/clinic/a"), ("h", "GPTBot", "/a.b/c"), ("h", "gptbot", "/aXb"), ("none", "GPTBot", "/")],
        "host string, bot string, path string",
    )
    got = {(r["host"], r["path"]): r["allowed"] for r in robots.check_paths(asked, files).collect()}
    assert got == {("h", "/"): False, ("h", "/clinic/a"): True, ("h", "/a.b/c"): False, ("h", "/aXb"): True, ("none", "/"): True}
