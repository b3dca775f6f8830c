"""Scoring, robots and comparison queries."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import compare, robots, scoring
from . import beds
from .core import query, table

_ITEM_COLUMNS = ["crawl", "schema", "price", "extract", "local", "eeat", "fresh", "answer", "citable"]
_SQL_COLUMNS = ["crawl", "schema_", "price", "extract_", "local_", "eeat", "fresh", "answer", "citable"]
_TOTAL = " + ".join(_SQL_COLUMNS)


@query("score_items", f"""WITH {beds.SIGNAL_POINTS}
SELECT p_partkey, {", ".join(f"CAST({s} AS INT) AS {c}" for c, s in zip(_ITEM_COLUMNS, _SQL_COLUMNS))} FROM points""")
def score_items(spark, sf):
    rows = scoring.with_items(beds.part_signals(spark, sf))
    return rows.select(
        "p_partkey", *[F.get("items", F.lit(i))["points"].alias(c) for i, c in enumerate(_ITEM_COLUMNS)]
    )


@query("item_status", f"""WITH {beds.SIGNAL_POINTS},
long(p_partkey, render, key, axis, points, ok_at) AS (
  SELECT p_partkey, render, unnest(['schema','price','extract','local','eeat','fresh','answer','citable']),
    unnest(['tech','tech','tech','tech','content','content','content','content']),
    unnest([schema_, price, extract_, local_, eeat, fresh, answer, citable]), unnest([8, 5, 7, 8, 11, 10, 8, 11]) FROM points)
SELECT p_partkey, key, CASE WHEN points >= ok_at THEN 'ok' WHEN points > 0 OR (render AND axis = 'content') THEN 'warn' ELSE 'fail' END AS status,
  CASE WHEN render AND axis = 'content' THEN 'limited' ELSE 'measured' END AS measurement FROM long
UNION ALL SELECT p_partkey, 'crawl', CASE WHEN crawl = 2 THEN 'fail' WHEN crawl = 15 THEN 'ok' ELSE 'warn' END, 'measured' FROM points""")
def item_status(spark, sf):
    return scoring.score_items(beds.part_signals(spark, sf), ["p_partkey"]).select("p_partkey", "key", "status", "measurement")


@query("page_scores", f"""WITH {beds.SIGNAL_POINTS}, t AS (
  SELECT p_partkey, render, {_TOTAL} AS score, crawl + schema_ + price + extract_ + local_ AS tech_score,
    eeat + fresh + answer + citable AS content_score, crawl = 2 AS blocked, citable = 0 AND NOT render AS bare FROM points),
b AS (SELECT *, CASE WHEN score >= 75 THEN '우수' WHEN score >= 50 THEN '보통' WHEN score >= 30 THEN '개선 여지 큼' ELSE '초기 단계' END AS raw_band FROM t)
SELECT p_partkey, CAST(score AS INT) AS score, CAST(tech_score AS INT) AS tech_score, CAST(content_score AS INT) AS content_score, raw_band,
  CASE WHEN (blocked OR bare OR render) AND raw_band = '우수' THEN '보통' ELSE raw_band END AS band,
  concat_ws(',', CASE WHEN blocked THEN 'crawl-blocked' END, CASE WHEN bare THEN 'no-citable-evidence' END, CASE WHEN render THEN 'measurement-limited' END) AS gates
FROM b""")
def page_scores(spark, sf):
    rows = scoring.page_scores(beds.part_signals(spark, sf), ["p_partkey"])
    return rows.select("p_partkey", "score", "tech_score", "content_score", "raw_band", "band", F.array_join("band_gates", ",").alias("gates"))


def _long_items(spark, sf):
    return beds.part_items_of(beds.parts(spark, sf)).select("p_partkey", F.inline("items"))


@query("total_band", f"""WITH {beds.ITEMS}, s AS (SELECT p_partkey, CAST(sum(points) AS BIGINT) AS score FROM items GROUP BY 1)
SELECT p_partkey, score, CASE WHEN score >= 75 THEN '우수' WHEN score >= 50 THEN '보통' WHEN score >= 30 THEN '개선 여지 큼' ELSE '초기 단계' END AS raw_band FROM s""")
def total_band(spark, sf):
    return scoring.total_band(_long_items(spark, sf), ["p_partkey"])


@query("axes", f"""WITH {beds.ITEMS}
SELECT p_partkey, CAST(sum(points) FILTER (axis = 'tech') AS BIGINT) AS tech_score, CAST(sum(max) FILTER (axis = 'tech') AS BIGINT) AS tech_max,
  CAST(sum(points) FILTER (axis = 'content') AS BIGINT) AS content_score, CAST(sum(max) FILTER (axis = 'content') AS BIGINT) AS content_max
FROM items GROUP BY 1""")
def axes(spark, sf):
    return scoring.axes(_long_items(spark, sf), ["p_partkey"])


@query("top_fixes", f"""WITH {beds.ITEMS}
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY max - points DESC, item_ord) AS fix_rank, key, fix, max - points AS gain
FROM items_fix WHERE fix IS NOT NULL QUALIFY fix_rank <= 3""")
def top_fixes(spark, sf):
    rows = scoring.top_fixes(_long_items(spark, sf), ["p_partkey"])
    return rows.select("p_partkey", F.col("fix_rank").cast("bigint").alias("fix_rank"), "key", "fix", "gain")


@query("verdict_line", f"""WITH {beds.ITEMS}, s AS (SELECT p_partkey, sum(points) AS score FROM items GROUP BY 1)
SELECT p_partkey, CASE WHEN p_partkey % 20 = 0 THEN 'capped' WHEN score >= 75 THEN 'AI가 인용하기 좋은 구조를 잘 갖추고 있습니다.'
  WHEN score >= 50 THEN '기본기는 갖췄고, 몇 가지만 보완하면 인용 가능성이 더 올라갑니다.'
  WHEN score >= 30 THEN '개선 여지가 큽니다 — 아래 항목이 채워지면 AI가 찾기 쉬워집니다.'
  ELSE '아직 AI가 인용할 구조가 거의 비어 있습니다. 좋은 소식은, 대부분 몇 가지 수정으로 채울 수 있다는 점입니다.' END AS verdict FROM s""")
def verdict_line(spark, sf):
    rows = scoring.total_band(_long_items(spark, sf), ["p_partkey"])
    note = F.when(F.col("p_partkey") % 20 == 0, F.lit("capped"))
    return rows.select("p_partkey", scoring.verdict_line(F.col("score"), note).alias("verdict"))


# --- robots: one file per page id, assembled from parts -----------------------------------------

_PARTS = [
    "User-agent: *\nAllow: /\nSitemap: https://x.example/map.xml\n",
    "User-agent: OAI-SearchBot\nUser-agent: ClaudeBot\nDisallow: /\n\nUser-agent: *\nAllow: /\n",
    "user-agent: GPTBot # training\nDisallow: /*\n",
    "User-agent: PerplexityBot\nDisallow: /blog/\nDisallow: /column$\nAllow: /blog/$\n",
    "User-agent: bot\nDisallow: /\n",
    "User-agent: *\nDisallow: /\nAllow: /about/\nAllow: /d*s/\n",
    "User-agent: Googlebot\nDisallow:\nUser-agent: Applebot\nDisallow: /board\nsitemap: https://y.example/s.xml\n",
    "<!doctype html><html>User-agent: *\nDisallow: /</html>",
    "Not Found",
]


def _robots_rows(spark, sf):
    """Two parts per page; the page id is the host."""
    n = F.col("page_id")
    parts = F.array(*[F.lit(p) for p in _PARTS])
    first = F.element_at(parts, (n % len(_PARTS) + 1).cast("int"))
    second = F.element_at(parts, (F.floor(n / len(_PARTS)) % 7 + 1).cast("int"))
    return table(spark, sf, "pages").select(
        n.alias("host"), F.when(n % 11 == 10, 404).otherwise(200).alias("status"),
        F.lit("text/plain").alias("content_type"), F.concat(first, F.lit("\n"), second).alias("body"),
    )


def _sql_parts() -> str:
    return ", ".join("'" + p.replace("'", "''").replace("\n", "'||chr(10)||'") + "'" for p in _PARTS)


_BOTS = ", ".join(f"({i}, '{t}', '{c}')" for i, (t, _, c) in enumerate(K.BOTS))
_PATHS = ", ".join(f"({i}, '{p}')" for i, p in enumerate(K.EVIDENCE_PATHS))
# The same rules, relationally: lines, running groups, bots x paths x rules.
ROBOTS = rf"""
bots(bot_ord, token, category) AS (VALUES {_BOTS}), paths(path_ord, path) AS (VALUES {_PATHS}),
files AS (
  SELECT page_id AS host, CASE WHEN page_id % 11 = 10 THEN 404 ELSE 200 END AS status,
    [{_sql_parts()}][CAST(page_id % {len(_PARTS)} + 1 AS INT)] || chr(10) || [{_sql_parts()}][CAST((page_id // {len(_PARTS)}) % 7 + 1 AS INT)] AS body FROM pages),
valid AS (
  SELECT host, body FROM files WHERE status = 200 AND NOT regexp_matches(body, '(?i)^\s*<(?:!doctype|html)') AND regexp_matches(body, '(?i)user-agent\s*:')),
lines AS (
  SELECT host, generate_subscripts(l, 1) AS no, trim(regexp_replace(unnest(l), '#.*$', '')) AS line FROM (SELECT host, string_split(body, chr(10)) AS l FROM valid)),
fields AS (
  SELECT host, no, lower(regexp_extract(line, '^([A-Za-z-]+)\s*:', 1)) AS field, trim(regexp_extract(line, '^[A-Za-z-]+\s*:(.*)$', 1)) AS value
  FROM lines WHERE regexp_matches(line, '^[A-Za-z-]+\s*:')),
opened AS (
  SELECT *, field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY host ORDER BY no), '') <> 'user-agent' AS opens FROM fields),
grouped AS (SELECT *, sum(opens::INT) OVER (PARTITION BY host ORDER BY no) AS g FROM opened),
agents AS (SELECT DISTINCT host, g, lower(value) AS agent FROM grouped WHERE field = 'user-agent'),
rules AS (SELECT host, g, no, field AS kind, value AS rule FROM grouped WHERE field IN ('allow', 'disallow') AND g > 0),
chosen AS (
  SELECT v.host, b.token, a.g FROM valid v CROSS JOIN bots b JOIN agents a ON a.host = v.host AND a.agent = lower(b.token)
  UNION ALL
  SELECT v.host, b.token, a.g FROM valid v CROSS JOIN bots b JOIN agents a ON a.host = v.host AND a.agent = '*'
  WHERE NOT EXISTS (SELECT 1 FROM agents x WHERE x.host = v.host AND x.agent = lower(b.token))),
best AS (
  SELECT c.host, c.token, p.path, max(length(rule)) FILTER (kind = 'allow') AS allow_len, max(length(rule)) FILTER (kind = 'disallow') AS deny_len
  FROM chosen c JOIN rules r ON r.host = c.host AND r.g = c.g CROSS JOIN paths p
  WHERE rule <> '' AND regexp_matches(p.path, '^' || replace(regexp_replace(regexp_replace(rule, '\$$', ''), '([.+?^${{}}()|\[\]\\])', '\\\1', 'g'), '*', '.*') || CASE WHEN suffix(rule, '$') THEN '$' ELSE '' END)
  GROUP BY ALL),
verdict AS (
  SELECT v.host, b.bot_ord, b.token, b.category, p.path_ord, p.path, coalesce(x.deny_len IS NULL OR coalesce(x.allow_len, -1) >= x.deny_len, TRUE) AS allowed
  FROM valid v CROSS JOIN bots b CROSS JOIN paths p LEFT JOIN best x ON x.host = v.host AND x.token = b.token AND x.path = p.path)
"""


@query("robots_rules", f"""WITH {ROBOTS}
SELECT r.host, kind, rule AS path, string_agg(agent, ',' ORDER BY agent) AS agents, count(*) AS n
FROM rules r JOIN agents a ON a.host = r.host AND a.g = r.g GROUP BY r.host, r.g, r.no, kind, rule""")
def robots_rules(spark, sf):
    rows = robots.robots_rules(_robots_rows(spark, sf)).where(F.col("path").isNotNull())
    agents = F.array_sort(F.array_distinct("agents"))
    return rows.select("host", "kind", "path", F.array_join(agents, ",").alias("agents"), F.size(agents).cast("bigint").alias("n"))


@query("path_allowed", f"""WITH {ROBOTS} SELECT host, token AS bot, path, allowed FROM verdict
UNION ALL SELECT host, token, path, TRUE FROM files CROSS JOIN bots CROSS JOIN paths WHERE host NOT IN (SELECT host FROM valid)""")
def path_allowed(spark, sf):
    files = _robots_rows(spark, sf)
    asked = files.select("host", F.explode(F.array(*[F.lit(t) for t, _, _ in K.BOTS])).alias("bot"))
    asked = asked.select("host", "bot", F.explode(F.array(*[F.lit(p) for p in K.EVIDENCE_PATHS])).alias("path"))
    return robots.check_paths(asked, files)


@query("robots_summary", f"""WITH {ROBOTS}, root AS (
  SELECT host, string_agg(token, ',' ORDER BY bot_ord) FILTER (NOT allowed) AS blocked_bots,
    string_agg(token, ',' ORDER BY bot_ord) FILTER (NOT allowed AND category = 'citation') AS blocked_citation,
    string_agg(token, ', ' ORDER BY bot_ord) FILTER (NOT allowed AND category = 'citation') AS citation_text,
    string_agg(token, ', ' ORDER BY bot_ord) FILTER (NOT allowed AND category = 'training') AS training_text
  FROM verdict WHERE path = '/' GROUP BY host),
part AS (
  SELECT v.host, v.bot_ord, v.token || '(' || string_agg(v.path, ' ' ORDER BY v.path_ord) || ')' AS t
  FROM verdict v JOIN verdict r ON r.host = v.host AND r.token = v.token AND r.path = '/' AND r.allowed
  WHERE v.category = 'citation' AND NOT v.allowed GROUP BY v.host, v.bot_ord, v.token),
parts AS (SELECT host, string_agg(t, ', ' ORDER BY bot_ord) AS partial FROM part GROUP BY host)
SELECT f.host, r.host IS NOT NULL AS present, coalesce(blocked_bots, '') AS blocked_bots, coalesce(blocked_citation, '') AS blocked_citation,
  citation_text IS NOT NULL AS blocks_any, nullif(regexp_extract(CASE WHEN r.host IS NOT NULL THEN body END, '(?im)^\\s*sitemap\\s*:\\s*(\\S+)', 1), '') AS sitemap,
  CASE WHEN r.host IS NULL THEN 'robots.txt 없음/판정불가 (SPA fallback 또는 미존재)'
    WHEN citation_text IS NOT NULL THEN '인용 경로 봇 차단: ' || citation_text
    WHEN partial IS NOT NULL THEN '일부 경로 차단: ' || partial
    WHEN training_text IS NOT NULL THEN '학습용 봇만 차단(인용 경로는 허용): ' || training_text ELSE 'AI 크롤러 차단 없음(허용)' END AS note
FROM files f LEFT JOIN root r USING (host) LEFT JOIN parts USING (host)""")
def robots_summary(spark, sf):
    rows = robots.robots_summary(_robots_rows(spark, sf))
    return rows.select(
        "host", "present", F.array_join("blocked_bots", ",").alias("blocked_bots"),
        F.array_join("blocked_citation", ",").alias("blocked_citation"), "blocks_any", "sitemap", "note",
    )


# --- comparison: a part against the next one ----------------------------------------------------

def _profiles(spark, sf):
    p = beds.part_items(spark, sf)
    k = F.col("p_partkey")
    return p.select(
        "p_partkey", "items", F.aggregate("items", F.lit(0), lambda a, x: a + x["points"]).alias("score"),
        F.struct(
            F.array(F.lit("Dentist")).alias("types"), (k % 2 == 0).alias("has_dental"), (k % 4).cast("int").alias("faq_count"),
            F.struct(F.lit("4.5").alias("value"), F.lit(2.0).alias("count")).alias("rating"), (k % 3 == 0).alias("has_breadcrumb"),
            F.struct(*[((k + i) % 3 == 0).alias(name) for i, (name, _) in enumerate(K.SCHEMA_FIELDS)]).alias("entity"),
        ).alias("jsonld"),
        F.when(k % 3 == 0, F.concat(F.lit("title "), k.cast("string"))).otherwise("").alias("title"),
        F.when(k % 4 == 0, F.lit("d")).otherwise(" ").alias("meta_description"), F.lit("og").alias("og_title"), F.lit("").alias("og_image"),
        F.when(k % 2 == 0, F.lit("https://c")).alias("canonical"), F.lit("w").alias("viewport"),
        F.when(k % 5 == 0, "NOINDEX, follow").when(k % 5 == 1, "index").otherwise("").alias("robots_meta"),
        *[((k * (i + 2)) % 7).cast("int").alias(c) for i, (_, _, c) in enumerate(K.CONTENT_NUMBERS)],
        *[(k % (i + 2) == 0).alias(c) for i, (_, _, c) in enumerate(K.CONTENT_FLAGS)],
    )


def _joined(spark, sf):
    pairs = table(spark, sf, "part").select(
        F.col("p_partkey").alias("user_key"), (F.col("p_partkey") + 1).alias("comp_key"), (F.col("p_partkey") % 3 > 0).alias("user_cited")
    )
    return compare.pair_profiles(pairs, _profiles(spark, sf), "p_partkey")


_COMPARED = ", ".join(f"({i}, '{k}')" for i, (k, *_rest) in enumerate(K.COMPARED_SIGNALS))
_PRODUCTS = ", ".join(f"('{k}', [{', '.join(repr(x) for x in ids)}])" for k, _, ids, _ in K.COMPARED_SIGNALS)
DIFF = beds.ITEMS + f""",
cmp(signal_ord, key) AS (VALUES {_COMPARED}),
diff AS (
  SELECT u.p_partkey AS user_key, cmp.signal_ord, cmp.key, u.max AS weight,
    CASE WHEN u.limited THEN 'na' ELSE u.status END AS user_status, coalesce(c.status, 'na') AS comp_status,
    CASE WHEN u.limited THEN 'same' WHEN u.status <> 'ok' AND c.status = 'ok' THEN 'gap' WHEN u.status = 'ok' AND coalesce(c.status, '') <> 'ok' THEN 'ahead' ELSE 'same' END AS verdict
  FROM items u JOIN cmp USING (key) LEFT JOIN items c ON c.p_partkey = u.p_partkey + 1 AND c.key = u.key)
"""


@query("signal_diff", f"WITH {DIFF} SELECT user_key, signal_ord, key, weight, user_status, comp_status, verdict FROM diff")
def signal_diff(spark, sf):
    return compare.signal_diff(_joined(spark, sf), ["user_key"]).select(
        "user_key", "signal_ord", "key", "weight", "user_status", "comp_status", "verdict"
    )


_FIELD_ROWS = ", ".join(f"({i}, '{k}')" for i, (k, _) in enumerate(K.SCHEMA_FIELDS))


@query("schema_diff", f"""WITH f(i, key) AS (VALUES {_FIELD_ROWS}),
h AS (SELECT p_partkey AS user_key, key, (p_partkey + i) % 3 = 0 AS user_has,
  p_partkey < (SELECT max(p_partkey) FROM part) AND (p_partkey + 1 + i) % 3 = 0 AS comp_has FROM part CROSS JOIN f)
SELECT *, CASE WHEN NOT user_has AND comp_has THEN 'gap' WHEN user_has AND NOT comp_has THEN 'ahead' ELSE 'same' END AS verdict FROM h""")
def schema_diff(spark, sf):
    return compare.schema_diff(_joined(spark, sf), ["user_key"]).drop("label")


@query("meta_diff", """WITH m AS (
  SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'title ' || p_partkey ELSE '' END AS title, p_partkey % 4 = 0 AS des, p_partkey % 2 = 0 AS can, p_partkey % 5 = 0 AS noindex FROM part),
j AS (SELECT u.k AS user_key, u.title AS ut, coalesce(c.title, '') AS ct, u.des AS ud, coalesce(c.des, FALSE) AS cd, u.can AS uc, coalesce(c.can, FALSE) AS cc, u.noindex AS un, coalesce(c.noindex, FALSE) AS cn, c.k IS NULL AS last FROM m u LEFT JOIN m c ON c.k = u.k + 1)
SELECT user_key, 'title' AS key, CASE WHEN ut = '' AND ct <> '' THEN 'gap' WHEN ut <> '' AND ct = '' THEN 'ahead' ELSE 'same' END AS verdict, FALSE AS warn_user, CAST(length(ut) AS INT) AS user_len FROM j
UNION ALL SELECT user_key, 'description', CASE WHEN NOT ud AND cd THEN 'gap' WHEN ud AND NOT cd THEN 'ahead' ELSE 'same' END, FALSE, 1 FROM j
UNION ALL SELECT user_key, 'canonical', CASE WHEN NOT uc AND cc THEN 'gap' WHEN uc AND NOT cc THEN 'ahead' ELSE 'same' END, FALSE, CASE WHEN uc THEN 9 ELSE 0 END FROM j
UNION ALL SELECT user_key, 'ogTitle', CASE WHEN last THEN 'ahead' ELSE 'same' END, FALSE, 2 FROM j
UNION ALL SELECT user_key, 'ogImage', 'same', FALSE, 0 FROM j
UNION ALL SELECT user_key, 'viewport', CASE WHEN last THEN 'ahead' ELSE 'same' END, FALSE, 1 FROM j
UNION ALL SELECT user_key, 'robots', CASE WHEN un AND NOT cn THEN 'gap' ELSE 'same' END, un, 0 FROM j""")
def meta_diff(spark, sf):
    rows = compare.meta_diff(_joined(spark, sf), ["user_key"])
    return rows.select("user_key", "key", "verdict", "warn_user", "user_len")


_NUMBERS = ", ".join(f"({i}, '{k}', {i + 2})" for i, (k, _, _) in enumerate(K.CONTENT_NUMBERS))
_FLAGS = ", ".join(f"({i}, '{k}', {i + 2})" for i, (k, _, _) in enumerate(K.CONTENT_FLAGS))
CONTENT = f"""
num(i, key, m) AS (VALUES {_NUMBERS}), flag(i, key, m) AS (VALUES {_FLAGS}), top AS (SELECT max(p_partkey) AS k FROM part),
content AS (
  SELECT p_partkey AS user_key, key, CAST((p_partkey * m) % 7 AS DOUBLE) AS user_value, CASE WHEN p_partkey < top.k THEN CAST(((p_partkey + 1) * m) % 7 AS DOUBLE) ELSE 0.0 END AS comp_value FROM part, num, top
  UNION ALL SELECT p_partkey, key, CAST((p_partkey % m = 0)::INT AS DOUBLE), CASE WHEN p_partkey < top.k THEN CAST(((p_partkey + 1) % m = 0)::INT AS DOUBLE) ELSE 0.0 END FROM part, flag, top)
"""


@query("content_diff", f"""WITH {CONTENT}
SELECT *, CASE WHEN comp_value > user_value THEN 'gap' WHEN user_value > comp_value THEN 'ahead' ELSE 'same' END AS verdict FROM content""")
def content_diff(spark, sf):
    return compare.content_diff(_joined(spark, sf), ["user_key"]).drop("label", "kind")


PLAN = DIFF + "," + CONTENT + f""",
products(key, ids) AS (VALUES {_PRODUCTS}, ('citability', ['blog-posting', 'media-feature']), ('notcited', ['blog-posting', 'media-feature', 'reboot-30'])),
rows_ AS (
  SELECT user_key, key, signal_ord + 1 AS o, weight * CASE WHEN verdict = 'gap' THEN 2.0 ELSE 1.0 END * CASE WHEN user_status = 'fail' THEN 1.0 ELSE 0.6 END AS severity
  FROM diff WHERE user_status <> 'ok'
  UNION ALL SELECT DISTINCT user_key, 'citability', 100, 9.0 FROM content WHERE key IN ('statistics', 'quotations', 'citedSources') AND comp_value > user_value
  UNION ALL SELECT p_partkey, 'notcited', 0, 999.0 FROM part WHERE p_partkey % 3 = 0),
plan AS (SELECT user_key, key, CAST(severity AS DOUBLE) AS severity, row_number() OVER (PARTITION BY user_key ORDER BY severity DESC, o) AS priority FROM rows_)
"""


@query("improvement_plan", f"WITH {PLAN} SELECT user_key, key, round(severity, 4) AS severity, CAST(priority AS INT) AS priority FROM plan")
def improvement_plan(spark, sf):
    rows = compare.improvement_plan(_joined(spark, sf), ["user_key"], "user_cited")
    return rows.select("user_key", "key", F.round("severity", 4).alias("severity"), "priority")


@query("recommended_products", f"""WITH {PLAN}, e AS (
  SELECT user_key, priority, generate_subscripts(ids, 1) AS pos, unnest(ids) AS id FROM plan JOIN products USING (key)),
f AS (SELECT user_key, id, min(priority * 100 + pos) AS o FROM e GROUP BY ALL),
s AS (SELECT user_key, string_agg(id, ',' ORDER BY o) AS products FROM f GROUP BY user_key)
SELECT p_partkey AS user_key, coalesce(products, '') AS products FROM part LEFT JOIN s ON s.user_key = p_partkey""")
def recommended_products(spark, sf):
    package = compare.compare_package(_joined(spark, sf), ["user_key"], "user_cited")
    return package.select("user_key", F.array_join("recommended_products", ",").alias("products"))


@query("gap_buckets", f"""WITH {beds.ITEMS}, b AS (
  SELECT u.p_partkey AS user_key, u.item_ord, u.key, u.limited, u.status = 'ok' AS u_ok, c.status = 'ok' AS c_ok
  FROM items u JOIN items c ON c.p_partkey = u.p_partkey + 1 AND c.key = u.key)
SELECT user_key, count(*) FILTER (limited) AS limited, count(*) FILTER (NOT limited AND NOT u_ok AND c_ok) AS gaps,
  count(*) FILTER (NOT limited AND u_ok AND c_ok) AS same, count(*) FILTER (NOT limited AND u_ok AND NOT c_ok) AS ahead
FROM b GROUP BY user_key UNION ALL SELECT max(p_partkey), 0, 0, 0, 0 FROM part""")
def gap_buckets(spark, sf):
    rows = compare.gap_buckets(_joined(spark, sf), ["user_key"])
    return rows.select("user_key", *[F.coalesce(F.size(c), F.lit(0)).cast("bigint").alias(c) for c in ("limited", "gaps", "same", "ahead")])


@query("product_triggers", """
SELECT p_partkey, concat_ws(',', 'geo-diagnosis', CASE WHEN NOT c OR s < 70 THEN 'content-hub' END, CASE WHEN NOT c THEN 'blog-posting' END,
  CASE WHEN NOT c THEN 'media-feature' END, 'geo-column', CASE WHEN NOT c THEN 'reboot-30' END, CASE WHEN NOT c OR s < 70 THEN 'geo-renewal' END,
  CASE WHEN NOT c THEN 'ai-column' END, CASE WHEN NOT c THEN 'shortform' END) AS products
FROM (SELECT p_partkey, p_partkey % 2 = 0 AS c, p_partkey % 101 AS s FROM part)""")
def product_triggers(spark, sf):
    p = table(spark, sf, "part")
    ids = compare.product_triggers(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 101)
    return p.select("p_partkey", F.array_join(ids, ",").alias("products"))


@query("solutions", f"""WITH {PLAN}, k AS (SELECT user_key, list(key) AS ks FROM plan GROUP BY user_key),
s AS (SELECT p_partkey AS user_key, coalesce(ks, []) AS ks FROM part LEFT JOIN k ON k.user_key = p_partkey),
h AS (SELECT user_key, concat_ws(',', CASE WHEN list_has_any(ks, ['schema','meta','answer','extract','local','crawl']) THEN 'geo-renewal' END,
  CASE WHEN list_has_any(ks, ['notcited','citability','eeat','fresh']) THEN 'ai-column' END, CASE WHEN list_has_any(ks, ['notcited','citability']) THEN 'shortform' END) AS s FROM s)
SELECT user_key, CASE WHEN s = '' THEN 'geo-renewal,ai-column,shortform' ELSE s END AS solutions FROM h""")
def solutions(spark, sf):
    package = compare.compare_package(_joined(spark, sf), ["user_key"], "user_cited")
    return package.select("user_key", F.array_join("solutions", ",").alias("solutions"))
