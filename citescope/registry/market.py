"""Place listings and the first-party funnel."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.storage import run_folder
from ..operators import funnel, panel, places
from ..sources import readers
from . import beds
from .core import query, table


@query("parse_count", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 2 THEN CAST(floor(abs(c_acctbal)) AS BIGINT)
  ELSE c_custkey * 1003 END AS reviews FROM customer""")
def parse_count(spark, sf):
    k = F.col("c_custkey")
    text = (
        F.when(k % 4 == 3, "N/A").when(k % 4 == 2, F.abs("c_acctbal").cast("string"))
        .when(k % 4 == 1, F.format_number(k * 1003, 0)).otherwise((k * 1003).cast("string"))
    )
    return table(spark, sf, "customer").select("c_custkey", places.parse_count(text).alias("reviews"))


@query("core_name", f"WITH {beds.PLACES} SELECT place_id, name, core FROM listing")
def core_name(spark, sf):
    return beds.places(spark, sf).select("place_id", "name", places.core_name("name").alias("core"))


@query("normalize_places", f"""WITH {beds.PLACES}
SELECT query, rank, CAST(place_id AS VARCHAR) AS place_id, 'https://map.naver.com/v5/entry/place/' || place_id AS map_url, name, phone,
  visitor_reviews, CASE WHEN place_id % 2 = 0 THEN 127.0 + place_id / 1000.0 END AS lng FROM places""")
def normalize_places(spark, sf):
    """The nested search response is written from the listings, then read by the reader."""
    raw = beds.places(spark, sf).select(
        F.col("query").cast("string").alias("query"), F.col("rank").cast("int").alias("start"), F.lit(1).cast("bigint").alias("total"),
        F.array(F.struct(
            F.col("place_id").cast("string").alias("id"), "name", F.lit("치과").alias("category"), F.lit("").alias("address"),
            F.lit(None).cast("string").alias("roadAddress"), "phone",
            F.when(F.col("place_id") % 2 == 0, (127.0 + F.col("place_id") / 1000.0).cast("string")).alias("x"), F.lit("37.5").alias("y"),
            F.format_number("visitor_reviews", 0).alias("visitorReviewCount"), F.lit("0").alias("blogCafeReviewCount"),
            F.lit("0").alias("bookingReviewCount"), F.lit("5").alias("imageCount"), F.lit(None).cast("string").alias("businessHours"),
        )).alias("items"),
    )
    folder = f"{run_folder(spark)}/places"
    raw.write.json(folder)
    rows = readers.read_place_results(spark, folder)
    return rows.select(
        F.col("query").cast("bigint").alias("query"), F.col("rank").cast("bigint").alias("rank"), "place_id", "map_url", "name", "phone",
        "visitor_reviews", "coords.lng",
    )


@query("match_target", f"WITH {beds.PLACES} SELECT query, site, tier, target_rank, place_id, place_name FROM matched")
def match_target(spark, sf):
    return places.match_target(beds.places(spark, sf), beds.sites(spark, sf))


@query("place_rank", f"""WITH {beds.PLACES}
SELECT s.query, s.site, m.target_rank, l.place_id, row_number() OVER (PARTITION BY s.query, s.site ORDER BY l.rank) AS competitor_no
FROM sites s LEFT JOIN matched m ON m.query = s.query AND m.site = s.site JOIN places l ON l.query = s.query AND l.place_id IS DISTINCT FROM m.place_id
QUALIFY competitor_no <= 5""")
def place_rank(spark, sf):
    listings, wanted = beds.places(spark, sf), beds.sites(spark, sf)
    matches = places.match_target(listings, wanted)
    rows = places.place_rank(listings, matches, sites=wanted)
    return rows.select("query", "site", "target_rank", "place_id", F.col("competitor_no").cast("bigint").alias("competitor_no"))


@query("local_rank", r"""
WITH i AS (SELECT page_id % 50 AS query, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS rank, page_id, url,
  regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages),
s AS (SELECT DISTINCT page_id % 50 AS query, CASE (page_id % 50) % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.net' ELSE 'example.org' END AS site FROM pages),
t AS (SELECT s.query, s.site, i.rank, i.page_id, host = site OR suffix(host, '.' || site) OR suffix(site, '.' || host) AS hit FROM s JOIN i ON i.query = s.query AND i.rank <= 5)
SELECT query, site, count(*) AS total_items, bool_or(hit) AS cited, min(rank) FILTER (hit) AS local_rank,
  arg_min('Clinic ' || page_id, rank) FILTER (hit) AS name FROM t GROUP BY query, site""")
def local_rank(spark, sf):
    from ..functions.ordered import top_k

    p = table(spark, sf, "pages").select((F.col("page_id") % 50).alias("query"), "page_id", F.col("url").alias("link"))
    ranked = top_k(p, ["query"], [F.col("page_id").asc()], K.LOCAL_TOP, "_r").select(
        "query", "link", F.concat(F.lit("<b>Clinic</b> "), F.col("page_id").cast("string")).alias("title"), F.col("_r").cast("bigint").alias("rank")
    )
    site = F.element_at(F.array(*[F.lit(x) for x in ("example.com", "example.net", "example.org")]), (F.col("query") % 3 + 1).cast("int"))
    wanted = p.select("query").distinct().withColumn("site", site)
    return places.local_rank(ranked, wanted)


@query("place_gaps", f"""WITH {beds.PLACES},
top AS (SELECT s.query, s.site, l.visitor_reviews, l.blog_reviews FROM sites s LEFT JOIN matched m USING (query, site)
  JOIN places l ON l.query = s.query AND l.place_id IS DISTINCT FROM m.place_id QUALIFY row_number() OVER (PARTITION BY s.query, s.site ORDER BY l.rank) = 1),
j AS (SELECT s.query, s.site, m.place_id IS NOT NULL AS matched, coalesce(l.booking_reviews, 0) AS b, coalesce(l.visitor_reviews, 0) AS v, coalesce(l.blog_reviews, 0) AS g,
  t.visitor_reviews AS tv, t.blog_reviews AS tb
  FROM sites s LEFT JOIN matched m USING (query, site) LEFT JOIN places l ON l.query = s.query AND l.place_id = m.place_id LEFT JOIN top t ON t.query = s.query AND t.site = s.site)
SELECT query, site, matched AND b > 0 AS booking_ok, matched AND tv IS NOT NULL AND (tv >= v * 2 OR tb >= g * 2) AS review_gap_big,
  CASE WHEN matched AND tv IS NOT NULL THEN CASE WHEN tv > v AND v > 0 THEN '격차 ×' || printf('%.1f', CAST(tv AS DOUBLE) / v) WHEN tv > v THEN '격차 큼' ELSE '우위' END END AS visitor_gap,
  3 + (matched AND b = 0)::INT + (NOT matched)::INT + (matched AND tv IS NOT NULL AND (tv >= v * 2 OR tb >= g * 2))::INT AS gaps
FROM j""")
def place_gaps(spark, sf):
    listings, wanted = beds.places(spark, sf), beds.sites(spark, sf)
    counts = ["booking_reviews", "visitor_reviews", "blog_reviews"]
    matches = places.match_target(listings, wanted, carry=counts)
    rows = places.first_rivals(listings, matches, wanted, counts)
    return places.place_gaps(rows, ["query", "site"]).select(
        "query", "site", "booking_ok", "review_gap_big", "visitor_gap", F.size("gaps").alias("gaps")
    )


# --- funnel ------------------------------------------------------------------------------------

def _sessions(spark, sf):
    e = table(spark, sf, "events")
    medium = F.when(F.col("event_type") == "error", "referral").otherwise(K.AI_MEDIUM)
    host = F.element_at(F.array(*[F.lit(h) for _, _, h in K.FUNNEL_LINKS]), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(
        "event_id", F.concat(host, F.lit(" / "), medium).alias("source_medium"), medium.alias("medium"), F.lit(1).cast("bigint").alias("sessions"),
        F.lit(1).cast("bigint").alias("users"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("bigint").alias("key_events"),
    )


SESSIONS = """
sessions AS (
  SELECT CASE user_id % 3 WHEN 0 THEN 'chatgpt.com' WHEN 1 THEN 'claude.ai' ELSE 'perplexity.ai' END || ' / ' || CASE WHEN event_type = 'error' THEN 'referral' ELSE 'ai-assistant' END AS source_medium,
    CASE WHEN event_type = 'error' THEN 'referral' ELSE 'ai-assistant' END AS medium, (event_type = 'purchase')::INT AS key_events FROM events)
"""


@query("ai_sessions_by_platform", f"""WITH {SESSIONS}
SELECT source_medium, count(*) AS sessions, count(*) AS users, CAST(sum(key_events) AS BIGINT) AS key_events, grouping(source_medium) = 1 AS is_total
FROM sessions WHERE medium = 'ai-assistant' GROUP BY GROUPING SETS ((source_medium), ())""")
def ai_sessions_by_platform(spark, sf):
    return funnel.ai_sessions_by_platform(funnel.keep_ai_sessions(_sessions(spark, sf)))


def _files(rows, per_file=500):
    """Enough files that each holds about `per_file` rows."""
    return max(4, -(-rows.count() // per_file))


@query("read_ai_sessions", f"""WITH {SESSIONS}
SELECT source_medium, count(*) AS sessions, CAST(sum(key_events) AS BIGINT) AS key_events FROM sessions WHERE medium = 'ai-assistant' GROUP BY ALL""")
def read_ai_sessions(spark, sf):
    """The nested export is written as many report files, then read by the reader."""
    value = lambda c: F.struct(F.col(c).cast("string").alias("value"))
    report = _sessions(spark, sf).select("event_id", F.array(F.struct(
        F.array(value("source_medium"), F.struct(F.lit("20260620").alias("value"))).alias("dimensionValues"),
        F.array(value("sessions"), value("users"), value("key_events")).alias("metricValues"),
    )).alias("rows"))
    folder = f"{run_folder(spark)}/sessions"
    busy = report.groupBy(F.pmod(F.xxhash64("event_id"), F.lit(_files(report))).alias("k")).agg(F.flatten(F.collect_list("rows")).alias("rows"))
    busy.write.partitionBy("k").json(folder)
    rows = readers.read_ai_sessions(spark, folder)
    return rows.groupBy("source_medium").agg(F.sum("sessions").alias("sessions"), F.sum("key_events").alias("key_events"))


_IDS = [i for _, ids in K.BOT_DETECTION_IDS for i in ids]
_NAMES = [b for b, ids in K.BOT_DETECTION_IDS for _ in ids]


def _bot_hits(spark, sf):
    e = table(spark, sf, "events")
    n = F.col("event_id")
    ids = F.array(*[F.lit(i) for i in _IDS])
    known = F.element_at(ids, (n % len(_IDS) + 1).cast("int")).cast("bigint")
    agent = F.element_at(F.array(*[F.lit(b) for b in K.UA_BOTS]), (n % len(K.UA_BOTS) + 1).cast("int"))
    return e.select(
        F.floor("value").cast("bigint").alias("count"),
        F.when(n % 5 == 0, F.array(F.lit(7).cast("bigint"))).when(n % 5 == 1, F.array(F.lit(7).cast("bigint"), known)).otherwise(F.array(known)).alias("detection_ids"),
        F.when(n % 4 == 0, F.concat(F.lit("Mozilla/5.0 (compatible; "), F.col("event_type"), F.lit(") long tail of an agent")))
        .when(n % 4 == 1, F.concat(F.lit("GPTBot/1.0 "), agent)).otherwise(F.concat(F.lit("Mozilla/5.0 "), agent, F.lit("/1.0"))).alias("user_agent"),
    )


_ID_LIST = ", ".join(f"'{b}'" for b in _NAMES)
_UA_LIST = ", ".join(f"'{b}'" for b in K.UA_BOTS)
HITS = f"""
hits AS (
  SELECT CAST(floor(value) AS BIGINT) AS n, CASE WHEN event_id % 5 = 0 THEN 'id:7' ELSE [{_ID_LIST}][CAST(event_id % {len(_IDS)} + 1 AS INT)] END AS by_id,
    CASE WHEN event_id % 4 = 0 THEN substring('Mozilla/5.0 (compatible; ' || event_type || ') long tail of an agent', 1, 40)
      ELSE [{_UA_LIST}][CAST(event_id % {len(K.UA_BOTS)} + 1 AS INT)] END AS by_agent FROM events)
"""


@query("bot_hits_precise", f"WITH {HITS} SELECT by_id AS bot, CAST(sum(n) AS BIGINT) AS hits FROM hits GROUP BY ALL")
def bot_hits_precise(spark, sf):
    return funnel.bot_hits_by_bot(_bot_hits(spark, sf))


@query("bot_hits_agent", f"WITH {HITS} SELECT by_agent AS bot, CAST(sum(n) AS BIGINT) AS hits FROM hits GROUP BY ALL")
def bot_hits_agent(spark, sf):
    return funnel.bot_hits_by_bot(_bot_hits(spark, sf), mode="ua")


@query("search_bots_crawling", f"WITH {HITS} SELECT CAST(sum(n) AS BIGINT) AS total, TRUE AS search_bots_crawling FROM hits")
def search_bots_crawling(spark, sf):
    return funnel.search_bots_crawling(funnel.bot_hits_by_bot(_bot_hits(spark, sf)))


@query("funnel", f"""WITH {HITS}, {SESSIONS}, {beds.ENGINE},
c AS (SELECT CASE WHEN by_id IN ('GPTBot', 'OAI-SearchBot', 'ChatGPT-User') THEN 'chatgpt' WHEN by_id LIKE 'Claude%' THEN 'claude' WHEN by_id LIKE 'Perplexity%' THEN 'perplexity' END AS engine,
  CAST(sum(n) AS BIGINT) AS crawl_hits FROM hits GROUP BY 1),
p AS (SELECT engine, CAST(sum(valid_runs) AS BIGINT) AS valid_runs, CAST(sum(cited_runs) AS BIGINT) AS cited_runs FROM engine_panel GROUP BY 1),
s AS (SELECT CASE WHEN source_medium LIKE 'chatgpt%' THEN 'chatgpt' WHEN source_medium LIKE 'claude%' THEN 'claude' ELSE 'perplexity' END AS engine,
  count(*) AS sessions, CAST(sum(key_events) AS BIGINT) AS key_events FROM sessions WHERE medium = 'ai-assistant' GROUP BY 1)
SELECT engine, crawl_hits, valid_runs, cited_runs, round(CAST(cited_runs AS DOUBLE) / valid_runs, 2) AS hit_rate, sessions, key_events
FROM c JOIN p USING (engine) JOIN s USING (engine)""")
def funnel_by_engine(spark, sf):
    by_bot = funnel.bot_hits_by_bot(_bot_hits(spark, sf))
    cited = panel.panel_by_engine(beds.runs(spark, sf), beds.KEYS)
    came = funnel.ai_sessions_by_platform(funnel.keep_ai_sessions(_sessions(spark, sf))).where(~F.col("is_total"))
    return funnel.funnel(by_bot, cited, came, [])
