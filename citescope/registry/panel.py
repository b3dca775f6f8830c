"""Panel, views and diagnosis over runs made from events, and over runs that cite page URLs."""

from pyspark.sql import functions as F

from ..operators import diagnosis, panel, reach, views
from ..operators.responses import as_response, match_citations, mention_position, names_mentioned, normalize_name
from ..plans.citation import outcomes_of
from . import beds
from .core import query, table

KEYS = beds.KEYS
_ENGINE_COLUMNS = (
    "site, region, procedure, engine, attempts, valid_runs, cited_runs, named_runs, errored_runs, "
    "inconclusive_runs, pos_top, pos_mid, pos_tail, hit_rate, cited, exposed, ci_low, ci_high, measured, unmeasurable"
)


@query("panel_by_engine", f"WITH {beds.ENGINE} SELECT {_ENGINE_COLUMNS} FROM engine_panel")
def panel_by_engine(spark, sf):
    return panel.panel_by_engine(beds.runs(spark, sf), KEYS)


@query("panel_by_prompt", f"""WITH {beds.PROMPTS}
SELECT site, region, procedure, engine, prompt, valid, cited, named, errored, inconclusive,
       round(CAST(cited AS DOUBLE) / nullif(valid, 0), 2) AS rate, first_ord FROM prompts""")
def panel_by_prompt(spark, sf):
    return panel.panel_by_prompt(beds.runs(spark, sf), KEYS)


_DISTRIBUTION = beds.PROMPTS + """,
dist AS (
  SELECT site, region, procedure, engine, count(*) AS prompts_scored,
         count(*) FILTER (cited = valid) AS always_cited, count(*) FILTER (cited = 0) AS never_cited
  FROM prompts WHERE valid > 0 GROUP BY ALL)
"""


@query("prompt_distribution", f"""WITH {_DISTRIBUTION}
SELECT site, region, procedure, engine, prompts_scored, always_cited, never_cited,
       prompts_scored - always_cited - never_cited AS sometimes_cited,
       round(1 - CAST(abs(always_cited - never_cited) AS DOUBLE) / prompts_scored, 2) AS spread,
       CAST(NULL AS VARCHAR) AS distribution_note FROM dist""")
def prompt_distribution(spark, sf):
    return panel.prompt_distribution(panel.panel_by_prompt(beds.runs(spark, sf), KEYS), KEYS)


@query("wilson_interval", """
SELECT p_partkey, CAST(p_partkey % 7 AS BIGINT) AS hits, CAST(p_partkey % 7 + p_partkey % 5 AS BIGINT) AS runs,
  CASE WHEN n > 0 THEN greatest(0.0, round((h / n + 3.8416 / (2 * n) - 1.96 * sqrt((h / n * (1 - h / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 3)) END AS low,
  CASE WHEN n > 0 THEN least(1.0, round((h / n + 3.8416 / (2 * n) + 1.96 * sqrt((h / n * (1 - h / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 3)) END AS high
FROM (SELECT p_partkey, CAST(p_partkey % 7 AS DOUBLE) AS h, nullif(CAST(p_partkey % 7 + p_partkey % 5 AS DOUBLE), 0) AS n FROM part)""")
def wilson_interval(spark, sf):
    from ..functions.stats import wilson

    p = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_partkey") % 7).alias("hits"), (F.col("p_partkey") % 7 + F.col("p_partkey") % 5).alias("runs")
    )
    ci = wilson("hits", "runs")
    return p.select("*", ci["low"].alias("low"), ci["high"].alias("high"))


@query("unmeasurable_reason", f"""WITH {beds.RUNS}, k AS (
  SELECT site, prompt, engine, count(*) FILTER (status = 'valid') AS v, count(*) FILTER (status = 'error') AS e, count(*) FILTER (status = 'inconclusive') AS i
  FROM runs GROUP BY ALL)
SELECT CASE WHEN v > 0 THEN NULL WHEN e > 0 THEN 'engine-error' WHEN i > 0 THEN 'no-search' ELSE 'no-key' END AS unmeasurable, count(*) AS engines FROM k GROUP BY ALL""")
def unmeasurable_reason(spark, sf):
    """Panels per site and prompt: small ones, so that every reason occurs."""
    rows = panel.panel_by_engine(beds.runs(spark, sf), ["site", "prompt"])
    return rows.groupBy("unmeasurable").agg(F.count(F.lit(1)).alias("engines"))


@query("panel_evidence", f"""WITH {beds.RUNS}
SELECT site, region, procedure, engine, prompt, run_ord, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen_at,
  CASE WHEN status = 'error' THEN 'HTTP 500' END AS error,
  CASE WHEN status = 'error' THEN 'error' WHEN status = 'inconclusive' THEN 'inconclusive' ELSE 'matched' END AS kind
FROM runs WHERE status IN ('error', 'inconclusive') OR cited""")
def panel_evidence(spark, sf):
    rows = panel.panel_evidence(beds.runs(spark, sf), KEYS)
    return rows.withColumn("seen_at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts")


@query("region_hit_map", f"""WITH {beds.ENGINE},
region_panel AS (
  SELECT region, engine, sum(valid_runs) AS v, sum(cited_runs) AS c FROM engine_panel GROUP BY ALL)
SELECT region,
  max(CASE WHEN engine = 'chatgpt' AND v > 0 THEN CAST(c AS BIGINT) || '/' || CAST(v AS BIGINT) END) AS chatgpt,
  max(CASE WHEN engine = 'claude' AND v > 0 THEN CAST(c AS BIGINT) || '/' || CAST(v AS BIGINT) END) AS claude,
  max(CASE WHEN engine = 'perplexity' AND v > 0 THEN CAST(c AS BIGINT) || '/' || CAST(v AS BIGINT) END) AS perplexity
FROM region_panel GROUP BY region""")
def region_hit_map(spark, sf):
    by_region = panel.panel_by_engine(beds.runs(spark, sf), ["region"])
    return panel.hit_map(by_region, ["region"])


@query("public_view", f"""WITH {beds.ENGINE}
SELECT site, region, procedure, engine, valid_runs, cited_runs, named_runs, inconclusive_runs, errored_runs,
  hit_rate, cited, exposed, measured, unmeasurable, ci_low, ci_high, 'public' AS view FROM engine_panel""")
def public_view(spark, sf):
    return views.public_view(panel.panel_by_engine(beds.runs(spark, sf), KEYS), KEYS)


@query("public_prompts", f"""WITH {beds.PROMPTS}
SELECT site, region, procedure, engine, prompt, valid, cited,
       round(CAST(cited AS DOUBLE) / nullif(valid, 0), 2) AS rate, inconclusive, errored FROM prompts""")
def public_prompts(spark, sf):
    return views.public_prompts(panel.panel_by_prompt(beds.runs(spark, sf), KEYS), KEYS)


@query("public_leak_scan", f"""WITH {beds.ENGINE}
SELECT site, engine, CAST(0 AS BIGINT) AS leaks FROM engine_panel WHERE FALSE""")
def public_leak_scan(spark, sf):
    view = views.public_view(panel.panel_by_engine(beds.runs(spark, sf), KEYS), KEYS)
    leaks = views.leak_scan(view, "site")
    return leaks.select("site", "engine", F.size("leaked_urls").cast("bigint").alias("leaks"))


@query("leak_scan_pages", r"""
SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, 'https?://[^"\s\\<]+'), lambda u: NOT contains(u, host))) AS BIGINT) AS leaks
FROM (SELECT page_id, url || ' ' || html AS html, CASE WHEN page_id % 2 = 0 THEN 'example.com' ELSE 'example.net' END AS host FROM pages)
WHERE len(list_filter(regexp_extract_all(html, 'https?://[^"\s\\<]+'), lambda u: NOT contains(u, host))) > 0""")
def leak_scan_pages(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id", "url", "html", F.when(F.col("page_id") % 2 == 0, "example.com").otherwise("example.net").alias("own")
    )
    return views.leak_scan(p, "own").select("page_id", F.size("leaked_urls").cast("bigint").alias("leaks"))


# --- runs that cite page URLs -----------------------------------------------------------------

@query("match_citations", f"""WITH {beds.URL_RUNS}
SELECT run_ord, site, count(*) AS citation_count, count(*) FILTER (domain = site) AS matched,
       count(DISTINCT domain) AS domains, bool_or(domain = site) AS cited
FROM cites GROUP BY run_ord, site""")
def match(spark, sf):
    rows = match_citations(beds.url_runs(spark, sf))
    return rows.select(
        "run_ord", "site", F.col("citation_count").cast("bigint").alias("citation_count"),
        F.size("matched_urls").cast("bigint").alias("matched"), F.size("cited_domains").cast("bigint").alias("domains"),
        (F.size("matched_urls") > 0).alias("cited"),
    )


@query("extract_citations", f"""WITH {beds.URL_RUNS}
SELECT run_ord, engine, count(*) AS urls, min(url) AS first_url, max(url) AS last_url, 'answer ' || run_ord AS answer,
       CAST(NULL AS VARCHAR) AS error
FROM (SELECT DISTINCT run_ord, engine, url FROM cites) GROUP BY run_ord, engine""")
def extract_citations(spark, sf):
    """Raw JSON is built per engine from the page URLs, then parsed back."""
    parsed = _parsed_url_runs(spark, sf)
    return parsed.select(
        "run_ord", "engine", F.size("urls").cast("bigint").alias("urls"), F.array_min("urls").alias("first_url"),
        F.array_max("urls").alias("last_url"), "answer", "error",
    )


def _raw_url_runs(spark, sf):
    answer = F.concat(F.lit("answer "), F.col("run_ord").cast("string"))
    return beds.url_runs(spark, sf).select(
        "run_ord", "site", "engine", "prompt", F.array(F.lit("answer 1")).alias("names"),
        as_response("engine", "urls", answer).alias("response"), F.lit(None).cast("string").alias("error"),
    )


def _parsed_url_runs(spark, sf):
    from ..operators.responses import parse_responses

    return parse_responses(_raw_url_runs(spark, sf))


@query("outcomes_from_responses", f"""WITH {beds.URL_RUNS}
SELECT run_ord, engine, 'valid' AS status, bool_or(domain = site) AS cited,
       contains('answer' || run_ord, 'answer1') AS named
FROM cites GROUP BY run_ord, engine""")
def outcomes_from_responses(spark, sf):
    return outcomes_of(_raw_url_runs(spark, sf)).select("run_ord", "engine", "status", "cited", "named")


_HOSTS = beds.URL_RUNS + """,
first_seen AS (
  SELECT site, engine, host AS domain, min(run_ord * 1000000 + page_id) AS first_seen, count(DISTINCT run_ord) AS runs
  FROM cites GROUP BY ALL)
"""


def _host_runs(spark, sf):
    """Outcome rows with hosts as domains: the test hosts share three registrable domains."""
    from ..functions.urls import url_host

    return beds.url_runs(spark, sf).select(
        "run_ord", "site", "engine", "prompt", F.lit("valid").alias("status"), F.lit(False).alias("cited"),
        F.array_distinct(F.transform("urls", lambda u: url_host(u))).alias("cited_domains"),
    )


@query("cited_domains", f"""WITH {_HOSTS}
SELECT site, engine, row_number() OVER (PARTITION BY site, engine ORDER BY first_seen) AS domain_ord, domain, runs
FROM first_seen QUALIFY domain_ord <= 15""")
def cited_domains(spark, sf):
    return panel.cited_domains(_host_runs(spark, sf), ["site"]).withColumn("domain_ord", F.col("domain_ord").cast("bigint"))


@query("compare_candidates", f"""WITH {_HOSTS}
SELECT * FROM (
SELECT site, engine, row_number() OVER (PARTITION BY site, engine ORDER BY first_seen) AS domain_ord, domain, runs
FROM first_seen QUALIFY domain_ord <= 15) WHERE domain NOT LIKE '%naver.com'""")
def compare_candidates(spark, sf):
    return panel.compare_candidates(_host_runs(spark, sf), ["site"]).withColumn("domain_ord", F.col("domain_ord").cast("bigint"))


@query("share_of_citations", f"""WITH {_HOSTS}, base AS (
  SELECT site, engine, count(DISTINCT run_ord) AS n FROM cites GROUP BY ALL)
SELECT site, engine, domain, runs, round(CAST(runs AS DOUBLE) / n, 4) AS share,
  rank() OVER (PARTITION BY site, engine ORDER BY runs DESC) AS share_rank
FROM first_seen JOIN base USING (site, engine)""")
def share_of_citations(spark, sf):
    return panel.share_of_citations(_host_runs(spark, sf), ["site"])


@query("citation_reach", f"""WITH {_HOSTS}, r AS (SELECT DISTINCT site, engine, run_ord, host FROM cites)
SELECT site, engine, count(DISTINCT run_ord % 9) AS days, count(DISTINCT run_ord) AS valid_runs, count(*) AS citations, count(DISTINCT host) AS exact_domains, true AS within_error
FROM r GROUP BY ALL""")
def citation_reach(spark, sf):
    """Domains by merged daily sketches, with the exact count beside them: off by no more than 3 percent, or by one."""
    runs = _host_runs(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("run_ord") % 9 * 86_400))
    about = reach.reach(reach.daily_reach(runs, ["site"]), ["site"])
    both = about.join(reach.exact_reach(runs, ["site"]), ["site", "engine"])
    off = F.abs(F.col("domains") - F.col("exact_domains"))
    return both.select(
        "site", "engine", "days", "valid_runs", "citations", "exact_domains",
        (off <= F.greatest(F.lit(1.0), 0.03 * F.col("exact_domains"))).alias("within_error"),
    )


@query("cited_path_match", r"""WITH p AS (
  SELECT page_id, page_id % 40 AS site, url,
    CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', '') = '' THEN '/'
         ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', '') END AS path FROM pages),
seen AS (SELECT DISTINCT site, path FROM p WHERE page_id % 3 = 0),
n AS (SELECT site, count(*) AS cited_paths FROM seen GROUP BY site)
SELECT p.page_id, p.site, p.path AS input_path, coalesce(n.cited_paths, 0) AS cited_paths,
  CASE WHEN s.path IS NOT NULL THEN 'exact' WHEN n.site IS NOT NULL THEN 'domain' ELSE 'none' END AS match
FROM p LEFT JOIN n ON p.site = n.site LEFT JOIN seen s ON s.site = p.site AND s.path = p.path""")
def cited_path_match(spark, sf):
    p = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 40).alias("site"), F.col("url").alias("input_url"))
    evidence = p.where(F.col("page_id") % 3 == 0).select(
        "site", F.lit("matched").alias("kind"), F.array("input_url").alias("matched_urls")
    )
    return views.cited_path_match(evidence, p, ["site"]).drop("input_url")


@query("private_view", f"""WITH {_HOSTS}, ranked AS (
  SELECT site, engine, domain, row_number() OVER (PARTITION BY site, engine ORDER BY first_seen) AS o FROM first_seen),
listed AS (SELECT site, engine, string_agg(domain, ',' ORDER BY o) AS candidates FROM ranked WHERE o <= 15 GROUP BY ALL)
SELECT site, engine, count(DISTINCT run_ord) AS attempts, any_value(candidates) AS candidates, 'private' AS view
FROM cites JOIN listed USING (site, engine) GROUP BY site, engine""")
def private_view(spark, sf):
    runs = _host_runs(spark, sf).withColumn("named", F.lit(False))
    rows = views.private_view(
        panel.panel_by_engine(runs, ["site"]), panel.compare_candidates(runs, ["site"]), ["site"]
    )
    return rows.select("site", "engine", "attempts", F.array_join("compare_candidates", ",").alias("candidates"), "view")


# --- answers from conversations ---------------------------------------------------------------

@query("mention_position", r"""
WITH a AS (SELECT conv_id, turn, text, instr(lower(text), 'the') - 1 AS pos FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN pos < 0 THEN NULL WHEN CAST(pos AS DOUBLE) / length(text) < 0.33 THEN 'top'
  WHEN CAST(pos AS DOUBLE) / length(text) < 0.67 THEN 'mid' ELSE 'tail' END AS position FROM a""")
def mention(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", mention_position(F.col("text"), F.lit("the")).alias("position"))


_NOISE = r"""[\s()\[\]{}·.,~!?'"“”‘’\-–—_/|:]+"""
_NOISE_SQL = _NOISE.replace("'", "''")


@query("names_mentioned", f"""
WITH a AS (SELECT conv_id, turn, regexp_replace(lower(text), '{_NOISE_SQL}', '', 'g') AS hay FROM conversations)
SELECT conv_id, turn, contains(hay, 'thatand') OR contains(hay, 'dieund') AS named, length(hay) AS hay_len FROM a""")
def named(spark, sf):
    names = F.array(F.lit("That. and"), F.lit("x"), F.lit("d-i"), F.lit("Die (und)"))
    c = table(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", names_mentioned("text", names).alias("named"),
        F.length(normalize_name("text")).cast("bigint").alias("hay_len"),
    )


@query("sample_answers", """
WITH a AS (SELECT conv_id % 7 AS site, CASE conv_id % 2 WHEN 0 THEN 'chatgpt' ELSE 'claude' END AS engine,
    'p' || (turn % 6) AS prompt, conv_id * 1000 + turn AS run_ord, text FROM conversations WHERE role = 'assistant'),
f AS (SELECT site, engine, prompt, min(run_ord) AS run_ord FROM a WHERE text <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site, engine ORDER BY run_ord) AS answer_ord FROM f)
SELECT r.site, r.engine, r.answer_ord, r.prompt, substring(a.text, 1, 1400) AS answer
FROM r JOIN a USING (site, engine, prompt, run_ord) WHERE answer_ord <= 3""")
def sample_answers(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        (F.col("conv_id") % 7).alias("site"), F.when(F.col("conv_id") % 2 == 0, "chatgpt").otherwise("claude").alias("engine"),
        F.concat(F.lit("p"), (F.col("turn") % 6).cast("string")).alias("prompt"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("run_ord"), F.lit("valid").alias("status"),
        F.lit(False).alias("cited"), F.col("text").alias("answer"),
    )
    return panel.sample_answers(c, ["site"]).drop("cited").withColumn("answer_ord", F.col("answer_ord").cast("bigint"))


# --- governance texts -------------------------------------------------------------------------

@query("mask_email", r"""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN lower(c_name) ELSE substring(lower(c_name), 1, 1) || '***@n' || c_nationkey || '.example.com' END AS masked
FROM customer""")
def mask_email(spark, sf):
    c = table(spark, sf, "customer")
    mail = F.concat(F.lower("c_name"), F.lit("@n"), F.col("c_nationkey").cast("string"), F.lit(".example.com"))
    text = F.when(F.col("c_custkey") % 5 == 0, F.lower("c_name")).otherwise(mail)
    return c.select("c_custkey", views.mask_email(text).alias("masked"))


@query("hash_ip", """
SELECT user_id, substring(sha256('10.0.0.' || user_id), 1, 16) AS ip_hash, count(*) AS hits FROM events GROUP BY ALL""")
def hash_ip(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    ip = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))
    return e.select("user_id", views.hash_ip(ip).alias("ip_hash"), "hits")


@query("forbidden_copy_scan", r"""
WITH t AS (SELECT doc_id, 'text' AS field, text AS copy FROM documents
  UNION ALL SELECT doc_id, 'claim', CASE doc_id % 6 WHEN 0 THEN '국내 1 위 ' WHEN 1 THEN '완치 100 %' WHEN 2 THEN 'no.1 ' WHEN 3 THEN 'No 1 ' ELSE '안내 ' END || source FROM documents)
SELECT doc_id, field, length(copy) AS copy_len FROM t
WHERE regexp_matches(copy, '(?i)최고|1\s*위|넘버\s*원|No\.?\s*1|유일|완치|보장|보증|100\s*%|최상급|명품')""")
def forbidden_copy_scan(spark, sf):
    d = table(spark, sf, "documents")
    lead = F.element_at(
        F.array(*[F.lit(x) for x in ("국내 1 위 ", "완치 100 %", "no.1 ", "No 1 ", "안내 ", "안내 ")]), (F.col("doc_id") % 6 + 1).cast("int")
    )
    rows = d.select("doc_id", "text", F.concat(lead, F.col("source")).alias("claim"))
    found = views.forbidden_copy_scan(rows, ["doc_id"], ["text", "claim"])
    return found.select("doc_id", "field", F.length("copy").cast("bigint").alias("copy_len"))


# --- diagnosis --------------------------------------------------------------------------------

_STATE = beds.ENGINE + """,
summary AS (
  SELECT site, region, procedure, count(*) AS engines, count(*) FILTER (measured) AS measured_engines,
    count(*) FILTER (measured AND cited_runs > 0) AS cited_engines,
    count(*) FILTER (measured AND cited_runs = 0 AND named_runs > 0) AS named_only,
    coalesce(bool_or(exposed) FILTER (measured), FALSE) AS any_exposed
  FROM engine_panel GROUP BY ALL),
scored AS (
  SELECT 'site' || p_partkey || '.example.com' AS site, (p_partkey * 7) % 101 AS score, p_partkey % 10 = 3 AS render,
         p_partkey % 8 = 1 AS crawl_fail, p_partkey % 6 = 0 AS bare, p_partkey % 7 = 0 AS unpriced, p_partkey % 9 = 0 AS undated FROM part),
state AS (
  SELECT * EXCLUDE (site, region, procedure, score, blocked, crawl_fail, render, bare, unpriced, undated), site, region, procedure,
         coalesce(score, 0) AS score, coalesce(render OR crawl_fail, FALSE) AS blocked, coalesce(crawl_fail, FALSE) AS crawl_fail,
         coalesce(render, FALSE) AS render, coalesce(bare, FALSE) AS bare, coalesce(unpriced, FALSE) AS unpriced,
         coalesce(undated, FALSE) AS undated, measured_engines IS NULL OR measured_engines > 0 AS judged
  FROM (SELECT *, NULL AS blocked FROM summary FULL JOIN scored USING (site)))
"""
_GAPS = """,
pr AS (
  SELECT site, region, procedure, engine, prompt, count(*) FILTER (status = 'valid') AS valid,
    count(*) FILTER (status = 'valid' AND cited) AS cited FROM runs GROUP BY ALL),
gap AS (
  SELECT site, region, procedure, engine, count(*) AS scored, count(*) FILTER (cited = valid) AS always_,
    count(*) FILTER (cited = 0) AS never_
  FROM pr WHERE valid > 0 GROUP BY ALL HAVING scored >= 2 AND always_ > 0 AND never_ > 0)
"""


def _structure(spark, sf):
    """Structure rows from part: score, render flag, a crawl item; the other items are fine."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    entry = lambda key, status, value: F.struct(
        F.lit(key).alias("key"), status.alias("status"), value.alias("points"), F.lit(f"{key} note").alias("note")
    )
    points = lambda m: F.when(k % m == 0, 0).otherwise(5)
    return p.select(
        F.concat(F.lit("site"), k.cast("string"), F.lit(".example.com")).alias("site"), (k * 7 % 101).alias("score"),
        F.lit("b").alias("band"), (k % 10 == 3).alias("needs_render"),
        F.array(
            entry("crawl", F.when(k % 8 == 1, "fail").otherwise("ok"), F.lit(5)), entry("extract", F.lit("ok"), F.lit(5)),
            entry("citable", F.lit("ok"), points(6)), entry("price", F.lit("ok"), points(7)), entry("fresh", F.lit("ok"), points(9)),
        ).alias("items"),
    )


def _diagnosed(spark, sf):
    runs = beds.runs(spark, sf)
    state = diagnosis.site_state(
        _structure(spark, sf), panel.panel_by_engine(runs, KEYS), KEYS, panel.panel_by_prompt(runs, KEYS)
    )
    return diagnosis.diagnose(state)


@query("findings", f"""WITH {_STATE} {_GAPS}, f AS (
  SELECT site, region, procedure, 'not-measured' AS code, 'info' AS severity, 1 AS o, '' AS e FROM state WHERE measured_engines = 0
  UNION ALL SELECT site, region, procedure, 'crawl-blocked', 'high', 2, '' FROM state WHERE judged AND crawl_fail
  UNION ALL SELECT site, region, procedure, 'js-rendered', 'high', 3, '' FROM state WHERE judged AND render
  UNION ALL SELECT site, region, procedure, 'no-citable-evidence', 'high', 7, '' FROM state WHERE judged AND bare
  UNION ALL SELECT site, region, procedure, 'no-price', 'medium', 8, '' FROM state WHERE judged AND unpriced
  UNION ALL SELECT site, region, procedure, 'no-date', 'medium', 9, '' FROM state WHERE judged AND undated
  UNION ALL SELECT site, region, procedure, 'named-not-linked', 'medium', 4, '' FROM state
    WHERE measured_engines > 0 AND NOT blocked AND named_only > 0 AND cited_engines = 0
  UNION ALL SELECT site, region, procedure, 'prompt-gap', 'medium', 5, engine FROM state JOIN gap USING (site, region, procedure)
    WHERE measured_engines > 0 AND NOT blocked
  UNION ALL SELECT site, region, procedure, 'structure-ok-not-exposed', 'medium', 6, '' FROM state
    WHERE measured_engines > 0 AND NOT blocked AND NOT any_exposed AND score >= 70)
SELECT site, region, procedure, code, severity,
  row_number() OVER (PARTITION BY site, region, procedure ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, o, e) AS finding_no
FROM f""")
def findings(spark, sf):
    rows = diagnosis.findings(_diagnosed(spark, sf), KEYS)
    return rows.select(*KEYS, "code", "severity", F.col("finding_no").cast("bigint").alias("finding_no"))


@query("diagnosis_headline", f"""WITH {_STATE}
SELECT site, region, procedure,
  CASE WHEN measured_engines = 0 THEN '이번 회차는 판정이 나오지 않았습니다(미측정). 미인용과 다릅니다.'
    WHEN blocked THEN '먼저 해결해야 할 필요조건이 막혀 있습니다. 이 상태에서는 다른 작업의 효과를 관측할 수 없습니다.'
    WHEN measured_engines IS NULL THEN '구조 진단 기준의 결과입니다. 실제 인용 여부는 별도 실측으로 확인합니다.'
    WHEN any_exposed THEN '이번 측정에서 답변에 노출됐습니다. 아래는 노출 폭을 넓히기 위해 비어 있는 항목입니다.'
    ELSE '읽히는 조건은 확인됐지만 이번 측정에서는 답변에 나오지 않았습니다.' END AS headline,
  measured_engines > 0 AS measured, CASE WHEN measured_engines > 0 THEN any_exposed END AS exposed
FROM state""")
def diagnosis_headline(spark, sf):
    return _diagnosed(spark, sf).select(*KEYS, "headline", "measured", "exposed")


@query("prompt_gap_texts", f"""WITH {_STATE} {_GAPS}, pm AS (
  SELECT site, region, procedure, engine, prompt, min(run_ord) AS first_ord FROM runs GROUP BY ALL),
never AS (
  SELECT site, region, procedure, engine, prompt, row_number() OVER (PARTITION BY site, region, procedure, engine ORDER BY first_ord) AS o
  FROM pr JOIN pm USING (site, region, procedure, engine, prompt) WHERE valid > 0 AND cited = 0),
quoted AS (
  SELECT site, region, procedure, engine, string_agg('"' || prompt || '"', ', ' ORDER BY o) AS q FROM never WHERE o <= 3 GROUP BY ALL)
SELECT site, region, procedure, engine || ': 질문에 따라 결과가 갈립니다' AS title,
  '측정한 ' || scored || '개 질의 중 ' || always_ || '개는 항상 인용됐고 ' || never_ || '개는 한 번도 인용되지 않았습니다.' AS detail,
  '인용되지 않은 질의: ' || q AS "check"
FROM state JOIN gap USING (site, region, procedure) JOIN quoted USING (site, region, procedure, engine)
WHERE measured_engines > 0 AND NOT blocked""")
def prompt_gap_texts(spark, sf):
    rows = diagnosis.findings(_diagnosed(spark, sf), KEYS)
    return rows.where(F.col("code") == "prompt-gap").select(*KEYS, "title", "detail", "check")


@query("diagnosis_by_region", f"""WITH {_STATE},
asked AS (SELECT DISTINCT site, region, procedure FROM runs
  UNION ALL SELECT DISTINCT site, 'failed', procedure FROM runs)
SELECT a.site, a.region, CASE WHEN a.region = 'failed' THEN 'unknown' END AS error, s.any_exposed AS exposed
FROM asked a LEFT JOIN state s USING (site, region, procedure)""")
def diagnosis_by_region(spark, sf):
    runs = beds.runs(spark, sf)
    done = runs.select(*KEYS).distinct().withColumn("error", F.lit(None).cast("string"))
    failed = done.select("site", F.lit("failed").alias("region"), "procedure").distinct().withColumn("error", F.lit("unknown"))
    rows = diagnosis.diagnose_by_region(
        _structure(spark, sf), panel.panel_by_engine(runs, KEYS), done.unionByName(failed), KEYS
    )
    return rows.select("site", "region", "error", F.col("any_exposed").alias("exposed"))
