"""URL, domain, header and address queries over page URLs and values derived from them."""

from pyspark.sql import functions as F

from ..functions import net, suffixes, urls
from ..functions.storage import run_folder
from .core import query, table

# Every third host becomes a Korean one with a two-label suffix, every seventh a bare host.
_VARIANT_SQL = r"""
v AS (
  SELECT page_id, CASE WHEN page_id % 7 = 6 THEN lower(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1)) ELSE u END AS u
  FROM (SELECT page_id, CASE page_id % 3 WHEN 1 THEN replace(replace(url, '.example.com', '.Clinic.co.kr'), '.example.net', '.smile.or.kr')
        ELSE url END AS u FROM pages)),
h AS (SELECT page_id, u, CASE WHEN contains(u, '://') THEN lower(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1)) ELSE lower(u) END AS host FROM v)
"""


def _variant(spark, sf):
    url = F.col("url")
    korean = F.replace(F.replace(url, F.lit(".example.com"), F.lit(".Clinic.co.kr")), F.lit(".example.net"), F.lit(".smile.or.kr"))
    u = F.when(F.col("page_id") % 3 == 1, korean).otherwise(url)
    bare = F.lower(F.regexp_extract(u, "^[a-z]+://([^/?#:]*)", 1))
    return table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 7 == 6, bare).otherwise(u).alias("u"))


@query("url_host", f"WITH {_VARIANT_SQL} SELECT page_id, host FROM h")
def url_host(spark, sf):
    return _variant(spark, sf).select("page_id", urls.url_host("u").alias("host"))


@query("registrable_domain", rf"""WITH {_VARIANT_SQL}
SELECT page_id, regexp_extract(host, '([^.]+\.(?:co\.kr|or\.kr|[^.]+))$', 1) AS domain FROM h""")
def registrable_domain(spark, sf):
    return _variant(spark, sf).select("page_id", urls.registrable_domain("u").alias("domain"))


_RULES = ["// rules of this query", "com", "kr", "co.kr", "or.kr", "org", "*.net", "!example.net  exception", "*.org", "!example.org", ""]


@query("registrable_domain_rules", rf"""WITH {_VARIANT_SQL}, w AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(host, 'example.net', 'sample.net') ELSE host END AS host FROM h)
SELECT page_id, CASE WHEN host LIKE '%.sample.net' THEN regexp_extract(host, '([^.]+\.sample\.net)$', 1)
  ELSE regexp_extract(host, '([^.]+\.(?:co\.kr|or\.kr|[^.]+))$', 1) END AS domain FROM w""")
def registrable_domain_rules(spark, sf):
    """The rules come from a file: plain ones, `*.net` with its exception, `*.org` with its exception."""
    folder = f"{run_folder(spark)}/rules"
    spark.createDataFrame([("\n".join(_RULES),)], "value string").coalesce(1).write.text(folder)
    rules = suffixes.read_suffix_rules(spark, folder)
    swapped = F.when(F.col("page_id") % 5 == 0, F.replace("u", F.lit("example.net"), F.lit("sample.net"))).otherwise(F.col("u"))
    return suffixes.with_registrable_domain(_variant(spark, sf).withColumn("u", swapped), "u", rules).select("page_id", "domain")


@query("unwrap_redirect", """
SELECT page_id, CASE page_id % 4
    WHEN 0 THEN 'https://vertexaisearch.cloud.google.com/grounding-api-redirect/abc?x=1&url=https%3A%2F%2Fsite' || page_id || '.example.com%2Fa'
    WHEN 1 THEN 'https://www.bing.com/ck?u=notaurl&q=https%3A%2F%2Fsite' || page_id || '.example.com%2Fa'
    WHEN 2 THEN 'https://www.bing.com/ck?x=https%3A%2F%2Fa.example' ELSE url END AS link,
  CASE WHEN page_id % 4 IN (0, 1) THEN 'https://site' || page_id || '.example.com/a'
    WHEN page_id % 4 = 2 THEN 'https://www.bing.com/ck?x=https%3A%2F%2Fa.example' ELSE url END AS target
FROM pages""")
def unwrap_redirect(spark, sf):
    n = F.col("page_id")
    to = F.concat(F.lit("https%3A%2F%2Fsite"), n.cast("string"), F.lit(".example.com%2Fa"))
    link = (
        F.when(n % 4 == 0, F.concat(F.lit("https://vertexaisearch.cloud.google.com/grounding-api-redirect/abc?x=1&url="), to))
        .when(n % 4 == 1, F.concat(F.lit("https://www.bing.com/ck?u=notaurl&q="), to))
        .when(n % 4 == 2, F.lit("https://www.bing.com/ck?x=https%3A%2F%2Fa.example"))
        .otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", link.alias("link"), urls.unwrap_redirect(link).alias("target"))


@query("same_site", rf"""WITH {_VARIANT_SQL}
SELECT page_id, regexp_extract(host, '([^.]+\.(?:co\.kr|or\.kr|[^.]+))$', 1) = 'clinic.co.kr' AS same FROM h""")
def same_site(spark, sf):
    target = urls.registrable_domain(F.lit("https://www.clinic.co.kr/about"))
    return _variant(spark, sf).select("page_id", urls.same_site("u", target).alias("same"))


def _with_platforms(spark, sf):
    u = F.when(F.col("page_id") % 4 == 0, F.replace("url", F.lit("example.com"), F.lit("naver.com"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", u.alias("url"))


@query("drop_platforms", r"""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN replace(url, 'example.com', 'naver.com') ELSE url END AS url
FROM pages WHERE NOT (page_id % 4 = 0 AND contains(url, 'example.com'))""")
def drop_platforms(spark, sf):
    return urls.drop_platforms(_with_platforms(spark, sf), "url")


@query("keep_platforms", r"""
SELECT page_id, replace(url, 'example.com', 'naver.com') AS url FROM pages WHERE page_id % 4 = 0 AND contains(url, 'example.com')""")
def keep_platforms(spark, sf):
    return urls.keep_platforms(_with_platforms(spark, sf), "url")


@query("url_problem", r"""
SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'bad-scheme' WHEN 1 THEN 'bad-port' WHEN 2 THEN 'userinfo-not-allowed'
  WHEN 3 THEN 'url-too-long' WHEN 4 THEN 'invalid-url' WHEN 5 THEN 'platform-url' END AS problem FROM pages""")
def url_problem(spark, sf):
    n, u = F.col("page_id") % 8, F.col("url")
    rest = F.regexp_replace(u, "^[a-z]+://", "")
    host_end = F.regexp_replace(rest, r"^([^/]+)", "$1:8443")
    made = (
        F.when(n == 0, F.concat(F.lit("ftp://"), rest)).when(n == 1, F.concat(F.lit("https://"), host_end))
        .when(n == 2, F.concat(F.lit("https://me:pw@"), rest)).when(n == 3, F.concat(u, F.repeat(F.lit("x"), 2048)))
        .when(n == 4, F.concat(F.lit("//"), rest)).when(n == 5, F.concat(F.lit("https://blog.naver.com/"), rest))
        .otherwise(u)
    )
    return table(spark, sf, "pages").select("page_id", urls.url_problem(made).alias("problem"))


@query("ip_scope", """
WITH n AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS ip FROM events)
SELECT event_id, CASE WHEN (ip >= 0 AND ip <= 16777215) OR (ip BETWEEN 167772160 AND 184549375)
  OR (ip BETWEEN 1681915904 AND 1686110207) OR (ip BETWEEN 2130706432 AND 2147483647)
  OR (ip BETWEEN 2851995648 AND 2852061183) OR (ip BETWEEN 2886729728 AND 2887778303)
  OR (ip BETWEEN 3221225472 AND 3221225727) OR (ip BETWEEN 3221225984 AND 3221226239)
  OR (ip BETWEEN 3227017984 AND 3227018239) OR (ip BETWEEN 3232235520 AND 3232301055)
  OR (ip BETWEEN 3323068416 AND 3323199487) OR (ip BETWEEN 3325256704 AND 3325256959)
  OR (ip BETWEEN 3405803776 AND 3405804031) OR ip >= 3758096384 THEN 'blocked-range-v4' ELSE 'public' END AS scope
FROM n""")
def ip_scope(spark, sf):
    n = F.col("event_id") * F.lit(2654435761) % F.lit(4294967296)
    ip = F.concat_ws(
        ".", *[(F.floor(n / d).cast("bigint") % 256).cast("string") for d in (16777216, 65536, 256, 1)]
    )
    return table(spark, sf, "events").select("event_id", net.ip_scope(ip).alias("scope"))


@query("public_hits", """
SELECT event_id, '8.' || (event_id % 256) || '.8.8' AS ip FROM events WHERE event_id % 3 <> 0""")
def public_hits(spark, sf):
    n = F.col("event_id")
    byte = (n % 256).cast("string")
    ip = F.when(n % 3 == 0, F.concat(F.lit("10."), byte, F.lit(".0.1"))).otherwise(F.concat(F.lit("8."), byte, F.lit(".8.8")))
    return net.public_only(table(spark, sf, "events").select("event_id", ip.alias("ip")), "ip")


@query("loose_host_match", r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host,
  CASE page_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'a.blog.example.net' ELSE regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') END AS site FROM pages)
SELECT page_id, host = site OR suffix(host, '.' || site) OR suffix(site, '.' || host) AS hit FROM h""")
def loose_host_match(spark, sf):
    n = F.col("page_id") % 3
    own = F.regexp_replace(urls.url_host("url"), r"^www\.", "")
    site = F.when(n == 0, "www.example.com").when(n == 1, "a.blog.example.net").otherwise(own)
    return table(spark, sf, "pages").select("page_id", urls.loose_host_match("url", site).alias("hit"))


@query("embeddable", """
SELECT page_id, page_id % 5 IN (0, 3) AS embeddable FROM pages""")
def embeddable(spark, sf):
    n = F.col("page_id") % 5
    cases = [
        {"content-type": "text/html"}, {"X-Frame-Options": "DENY"},
        {"Content-Security-Policy": "default-src *; frame-ancestors 'self'"},
        {"CONTENT-SECURITY-POLICY": "img-src x; frame-ancestors *"},
        {"content-security-policy": "frame-ancestors https://a.example"},
    ]
    chain = None
    for i, case in enumerate(cases):
        value = F.create_map(*[F.lit(x) for pair in case.items() for x in pair])
        chain = F.when(n == i, value) if chain is None else chain.when(n == i, value)
    headers = F.map_concat(chain, F.create_map(F.lit("x-url"), F.col("url")))
    return table(spark, sf, "pages").select("page_id", urls.embeddable(headers).alias("embeddable"))
