"""History, limits, planning, quality and stream twins."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import history, limits, measurement, notes, panel
from ..functions.storage import run_folder
from . import beds
from .core import SQL, dealt, query, table
from .pages import AUDIT

NOW = datetime(1998, 8, 2)
NOW_SQL = "TIMESTAMP '1998-08-02'"


def _now():
    return F.lit(NOW).cast("timestamp")


# --- history -------------------------------------------------------------------------------------

@query("last_n_history", f"""WITH {beds.HISTORY}
SELECT site, record_id, score, row_number() OVER (PARTITION BY site ORDER BY ts DESC, record_id DESC) AS hist_no
FROM history WHERE ts >= {NOW_SQL} - INTERVAL 1800 DAY QUALIFY hist_no <= 5""")
def last_n_history(spark, sf):
    rows = history.last_n_history(beds.history(spark, sf), ["site"], _now(), 5, 1800, tiebreak=["record_id"])
    return rows.select("site", "record_id", "score", F.col("hist_no").cast("bigint").alias("hist_no"))


@query("last_30_days_90", f"""WITH {beds.HISTORY}
SELECT site, record_id, score, row_number() OVER (PARTITION BY site ORDER BY ts DESC, record_id DESC) AS hist_no
FROM history WHERE ts >= {NOW_SQL} - INTERVAL 90 DAY QUALIFY hist_no <= 30""")
def last_30_days_90(spark, sf):
    rows = history.last_n_history(beds.history(spark, sf), ["site"], _now(), tiebreak=["record_id"])
    return rows.select("site", "record_id", "score", F.col("hist_no").cast("bigint").alias("hist_no"))


@query("score_delta", f"""WITH {beds.HISTORY}, l AS (
  SELECT *, lag(score) OVER (PARTITION BY site ORDER BY ts, record_id) AS prev_score FROM history)
SELECT site, record_id, score, prev_score, score - prev_score AS delta,
  CASE WHEN score > prev_score THEN 'up' WHEN score < prev_score THEN 'down' WHEN score = prev_score THEN 'same' ELSE 'first' END AS direction FROM l""")
def score_delta(spark, sf):
    return history.score_delta(beds.history(spark, sf), ["site"], tiebreak=["record_id"]).drop("ts")


@query("trend_12", f"""WITH {beds.HISTORY}, k AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts DESC, record_id DESC) AS n FROM history QUALIFY n <= 12)
SELECT site, count(*) AS points, arg_max(score, n) AS first_score, arg_min(score, n) AS last_score, arg_min(score, n) - arg_max(score, n) AS change
FROM k GROUP BY site HAVING count(*) >= 2""")
def trend_12(spark, sf):
    return history.trend(beds.history(spark, sf), ["site"], tiebreak=["record_id"])


@query("repeatability", f"""WITH {beds.HISTORY}
SELECT site, count(*) AS measurements, min(score) AS min_score, max(score) AS max_score, round(stddev_pop(score), 4) AS score_stddev, max(score) - min(score) AS spread
FROM history GROUP BY site HAVING count(*) >= 2""")
def repeatability(spark, sf):
    return history.repeatability(beds.history(spark, sf), ["site"])


@query("citation_history_matrix", f"""WITH {beds.ENGINE}
SELECT site, region, procedure, max(CASE WHEN engine = 'chatgpt' THEN cited_runs || '/' || valid_runs END) AS chatgpt,
  max(CASE WHEN engine = 'claude' THEN cited_runs || '/' || valid_runs END) AS claude, max(CASE WHEN engine = 'perplexity' THEN cited_runs || '/' || valid_runs END) AS perplexity
FROM engine_panel GROUP BY ALL""")
def citation_history_matrix(spark, sf):
    rows = panel.panel_by_engine(beds.runs(spark, sf), beds.KEYS)
    return history.citation_history_matrix(history.citation_record(rows, beds.KEYS, _now()), beds.KEYS)


@query("recent_months", """
SELECT o_custkey AS domain, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders
WHERE strftime(o_orderdate, '%Y-%m') IN ('1998-08', '1998-07', '1998-06', '1998-05', '1998-04', '1998-03') GROUP BY ALL""")
def recent_months(spark, sf):
    monthly = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("domain"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return history.recent_months(monthly, _now())


@query("latest_monthly", """
SELECT o_custkey AS domain, strftime(o_orderdate, '%Y-%m') AS period, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS record_id FROM orders GROUP BY ALL""")
def latest_monthly(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("domain"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderkey").alias("record_id"),
        F.col("o_orderdate").alias("saved_at"),
    )
    return history.latest_monthly(rows, tiebreak=["record_id"]).drop("saved_at")


@query("sanitize_monthly", """
SELECT o_orderkey, CASE WHEN o_orderkey % 150 <= 100 THEN CAST(o_orderkey % 150 AS DOUBLE) END AS natural_visit_rate,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_totalprice * 5 <= 1000000 THEN round(o_totalprice * 5, 4) END AS call_clicks,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END AS saves FROM orders""")
def sanitize_monthly(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        "o_orderkey", (k % 150).cast("string").alias("natural_visit_rate"),
        F.when(k % 7 == 0, "abc").otherwise(F.round(F.col("o_totalprice") * 5, 4).cast("string")).alias("call_clicks"),
        F.when(k % 3 == 0, "-1").otherwise((k % 3).cast("string")).alias("saves"),
    )
    return history.sanitize_monthly(raw)


@query("staleness", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN TRUE ELSE date_diff('second', o_orderdate, {NOW_SQL}) / 86400.0 > 21 END AS stale FROM orders""")
def staleness(spark, sf):
    text = F.when(F.col("o_orderkey") % 10 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", history.is_stale(text, _now()).alias("stale"))


@query("score_vs_citation", f"""WITH {beds.ENGINE}, s AS (
  SELECT 'site' || p_partkey || '.example.com' AS site, (p_partkey * 7) % 101 AS score,
    CASE WHEN (p_partkey * 7) % 101 >= 75 THEN '우수' WHEN (p_partkey * 7) % 101 >= 50 THEN '보통' WHEN (p_partkey * 7) % 101 >= 30 THEN '개선 여지 큼' ELSE '초기 단계' END AS band FROM part),
c AS (SELECT site, count(*) FILTER (measured) > 3 AS measured, coalesce(bool_or(exposed) FILTER (measured AND engine = 'claude'), FALSE) AS exposed FROM engine_panel GROUP BY site),
j AS (SELECT band, score, CASE WHEN measured THEN exposed::INT::DOUBLE END AS hit, coalesce(measured, FALSE) AS measured FROM s LEFT JOIN c USING (site))
SELECT coalesce(band, '(all)') AS band, count(*) AS sites, count(*) FILTER (measured) AS measured_sites, count(*) FILTER (hit = 1) AS exposed_sites,
  round(avg(hit), 4) AS exposure_rate, round(avg((NOT measured)::INT), 4) AS unmeasurable_share FROM j GROUP BY GROUPING SETS ((band), ())""")
def score_vs_citation(spark, sf):
    from ..operators.scoring import band_of

    p = table(spark, sf, "part")
    score = F.col("p_partkey") * 7 % 101
    scores = p.select(F.concat(F.lit("site"), F.col("p_partkey").cast("string"), F.lit(".example.com")).alias("site"), score.alias("score"), band_of(score).alias("band"))
    by_engine = panel.panel_by_engine(beds.runs(spark, sf), beds.KEYS)
    # A site counts as measured here when more than three of its panels are, and as exposed by one engine.
    strict = by_engine.groupBy("site").agg(
        (F.count_if("measured") > 3).alias("measured"),
        F.coalesce(F.bool_or(F.when(F.col("measured") & (F.col("engine") == "claude"), F.col("exposed"))), F.lit(False)).alias("exposed"),
    )
    return history.score_vs_citation(scores, strict).drop("correlation")


@query("score_citation_correlation", f"""WITH {beds.HISTORY}, {beds.RUNS}, s AS (
  SELECT site, avg(score) AS score FROM history GROUP BY site),
c AS (SELECT CAST(regexp_extract(site, '([0-9]+)', 1) AS BIGINT) AS site, avg(cited::INT) > 0.2 AS exposed FROM runs GROUP BY 1)
SELECT round(corr(score, exposed::INT), 4) AS correlation, count(*) AS sites FROM s LEFT JOIN c USING (site)""")
def score_citation_correlation(spark, sf):
    scores = beds.history(spark, sf).groupBy("site").agg(F.avg("score").alias("score")).withColumn("band", F.lit("-"))
    seen = beds.runs(spark, sf).groupBy(F.regexp_extract("site", r"(\d+)", 1).cast("bigint").alias("site")).agg(
        (F.avg(F.col("cited").cast("int")) > 0.2).alias("exposed")
    ).withColumn("measured", F.lit(True))
    return history.score_vs_citation(scores, seen).where(F.col("band") == "(all)").select("correlation", "sites")


@query("measurability", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'measured' WHEN 1 THEN 'timeout' WHEN 2 THEN 'unmeasurable:blocked' WHEN 3 THEN 'unmeasurable:tls' WHEN 4 THEN 'vendor-failure'
  ELSE 'render-needed' END AS state FROM events""")
def measurability(spark, sf):
    n = F.col("event_id") % 6
    reason = F.element_at(F.array(*[F.lit(x) for x in ("", "timeout", "blocked-ip", "tls handshake", "HTTP 500", "")]), (n + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", history.measurability(reason, n == 5).alias("state"))


# --- notes and feeds -----------------------------------------------------------------------------

@query("valid_notes", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence, 'fieldnote' AS kind FROM pages WHERE page_id % 4 <> 0 AND page_id % 5 <> 0""")
def valid_notes(spark, sf):
    n = F.col("page_id")
    raw = table(spark, sf, "pages").select(
        "page_id", F.when(n % 4 > 0, F.lit("t")).otherwise("").alias("title"), F.lit("s").alias("summary"),
        F.when(n % 5 == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url")).alias("url"),
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("client_action"),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("sure")), (n % 3 + 1).cast("int")).alias("confidence"),
    )
    return notes.valid_notes(raw).select("page_id", "confidence", "kind")


@query("valid_benchmarks", "SELECT item_id, 'benchmark' AS kind, '' AS note FROM benchmark WHERE item_id % 3 > 0 AND text <> ''")
def valid_benchmarks(spark, sf):
    raw = table(spark, sf, "benchmark").select(
        "item_id", F.col("text").alias("label"), F.when(F.col("item_id") % 3 > 0, F.lit("m")).alias("metric"),
        *[F.lit(None).cast("string").alias(c) for c in ("as_of", "note", "sample_note")],
    )
    return notes.valid_benchmarks(raw).select("item_id", "kind", "note")


@query("feed_candidates", """
SELECT source AS feed, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS candidate_no FROM documents
WHERE regexp_matches(text, '(?i)ai search|generative engine|geo|aeo|ai overview|sge|chatgpt|perplexity|answer engine|citation|grounding|ai mode|gemini|copilot|llm|that')
QUALIFY candidate_no <= 6""")
def feed_candidates(spark, sf):
    items = table(spark, sf, "documents").select(F.col("source").alias("feed"), "doc_id", F.col("text").alias("title"), F.col("doc_id").alias("item_no"))
    rows = notes.feed_candidates(items, keywords=K.NEWS_KEYWORDS + "|that")
    return rows.select("feed", "doc_id", F.col("candidate_no").cast("bigint").alias("candidate_no"))


# --- planning ------------------------------------------------------------------------------------

def _targets(spark, sf):
    # A target becomes up to 72 calls.
    k = F.col("s_suppkey")
    return dealt(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", 5_000).select(
        "s_suppkey", F.when(k % 4 < 2, F.concat(F.lit(" 구역"), k.cast("string"))).otherwise("").alias("district"),
        F.when(k % 2 == 0, "임플란트 ").otherwise("").alias("procedure"), F.when(k % 3 == 0, "피부과").otherwise("").alias("business_type"),
    )


_BASE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
TARGETS = """
t AS (
  SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN '구역' || s_suppkey ELSE '' END AS d, CASE WHEN s_suppkey % 2 = 0 THEN '임플란트' ELSE '' END AS p,
    CASE WHEN s_suppkey % 3 = 0 THEN '피부과' ELSE '치과' END AS b FROM supplier)
"""
VARIANTS = TARGETS + f""",
v AS (
  SELECT s_suppkey, 0 AS o, {_BASE.format("d || ' ' || p || ' 잘하는 ' || b || ' 추천해줘'")} AS prompt FROM t
  UNION ALL SELECT s_suppkey, 1, {_BASE.format("d || '에서 ' || p || ' ' || b || ' 비교'")} FROM t
  UNION ALL SELECT s_suppkey, 2, {_BASE.format("d || ' ' || b || ' 추천'")} FROM t
  UNION ALL SELECT s_suppkey, 3, {_BASE.format("d || ' ' || p || ' 비용이 얼마예요'")} FROM t
  UNION ALL SELECT s_suppkey, 4, d || ' 출퇴근하는데 ' || p || ' 할 ' || b || ' 어디가 좋아?' FROM t WHERE d <> '' AND p <> ''
  UNION ALL SELECT s_suppkey, 5, d || ' 근처 ' || p || ' ' || b || ' 아무데나 예약해도 괜찮을까?' FROM t WHERE d <> '' AND p <> ''
  UNION ALL SELECT s_suppkey, 6, p || ' 해야 하는데 ' || d || ' 쪽 어디 가면 돼?' FROM t WHERE d <> '' AND p <> ''
  UNION ALL SELECT s_suppkey, 7, p || ' ' || d || ' 잘하는 데 어딘지 알려줘' FROM t WHERE d <> '' AND p <> ''
  UNION ALL SELECT s_suppkey, 8, d || '에서 ' || p || ' 잘해준다는 ' || b || ' 찾는데 추천해줘' FROM t WHERE d <> '' AND p <> ''
  UNION ALL SELECT s_suppkey, 9, d || ' 근처 ' || b || ' 아무데나 괜찮은 곳 있어?' FROM t WHERE d <> '' AND p = ''
  UNION ALL SELECT s_suppkey, 10, p || ' 잘하는 ' || b || ' 추천해줘' FROM t WHERE d = '' AND p <> '')
"""


@query("query_variants", f"""WITH {VARIANTS}
SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY o) - 1 AS INT) AS ordinal, prompt FROM v""")
def query_variants(spark, sf):
    return measurement.query_variants(_targets(spark, sf)).select("s_suppkey", "ordinal", "prompt")


@query("default_prompts", f"""WITH {VARIANTS}
SELECT s_suppkey, prompt, 'You are helping a user in ' || CASE WHEN d = '' THEN '한국' ELSE d END || ' find a ' || b || '. Use web search.' AS system
FROM v JOIN t USING (s_suppkey) WHERE o < 4""")
def default_prompts(spark, sf):
    return measurement.default_prompts(_targets(spark, sf)).select("s_suppkey", "prompt", "system")


@query("select_prompts", f"""WITH {VARIANTS}, n AS (SELECT s_suppkey, prompt, row_number() OVER (PARTITION BY s_suppkey ORDER BY o) - 1 AS i FROM v)
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN (SELECT string_agg(prompt, '|' ORDER BY -i) FROM n WHERE n.s_suppkey = s.s_suppkey AND i IN (0, 2))
    WHEN 1 THEN 'own ' || s_suppkey || '|b' ELSE (SELECT string_agg(prompt, '|' ORDER BY i) FROM n WHERE n.s_suppkey = s.s_suppkey AND i < 4) END AS prompts,
  CASE s_suppkey % 3 WHEN 0 THEN 'indexes:2,0' WHEN 1 THEN 'b§own ' || s_suppkey ELSE '' END AS query_fp
FROM supplier s""")
def select_prompts(spark, sf):
    k = F.col("s_suppkey")
    asked = _targets(spark, sf).withColumns({
        "query_indexes": F.when(k % 3 == 0, F.array(*[F.lit(x) for x in ("2", "99", "0", "2", "-1", "x", "0.5")])),
        "queries": F.when(k % 3 == 1, F.array(F.concat(F.lit(" own "), k.cast("string")), F.lit(" "), F.lit("b"), F.lit("ignored"))),
    })
    return measurement.select_prompts(asked).select("s_suppkey", F.array_join("prompts", "|").alias("prompts"), "query_fp")


def _planned(spark, sf):
    k = F.col("s_suppkey")
    asked = _targets(spark, sf).withColumns({
        "query_indexes": F.lit(None).cast("array<string>"), "queries": F.lit(None).cast("array<string>"),
        "_regions": F.when(k % 2 == 0, F.array(F.lit(" b "), F.lit("a"), F.lit(""), F.lit("b"))), "_one": F.lit(" solo "),
    })
    chosen = measurement.select_prompts(asked)
    return chosen.withColumn("regions", measurement.normalize_regions("_regions", "_one")).drop("_regions", "_one", "query_indexes", "queries")


@query("normalize_regions", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'b,a' ELSE 'solo' END AS regions FROM supplier")
def normalize_regions(spark, sf):
    return _planned(spark, sf).select("s_suppkey", F.array_join("regions", ",").alias("regions"))


@query("run_manifest", """
SELECT s_suppkey, region, engine, CAST(3 * 4 AS BIGINT) AS calls, CASE engine WHEN 'chatgpt' THEN 'required' WHEN 'claude' THEN 'web_search_20250305' ELSE 'sonar' END AS mark
FROM supplier, (SELECT unnest(['chatgpt', 'claude', 'perplexity']) AS engine), (SELECT unnest(['b', 'a', 'solo']) AS region)
WHERE (s_suppkey % 2 = 0) = (region <> 'solo')""")
def run_manifest(spark, sf):
    m = measurement.run_manifest(_planned(spark, sf))
    request = F.col("request")
    sign = (
        F.when(F.get_json_object(request, "$.tools[0].type") == "web_search", F.get_json_object(request, "$.tool_choice"))
        .when(F.get_json_object(request, "$.max_tokens") == "1024", F.get_json_object(request, "$.tools[0].type"))
        .otherwise(F.get_json_object(request, "$.model"))
    )
    return m.groupBy("s_suppkey", "region", "engine").agg(F.count(F.lit(1)).alias("calls"), F.first(sign).alias("mark"))


@query("call_budget", """
SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 72 ELSE 36 END AS BIGINT) AS calls,
  CASE WHEN s_suppkey % 2 = 0 THEN '2지역 × 3엔진 × 4질의 × 3회 = 72회 호출' ELSE '1지역 × 3엔진 × 4질의 × 3회 = 36회 호출' END AS note FROM supplier""")
def call_budget(spark, sf):
    return measurement.call_budget(measurement.run_manifest(_planned(spark, sf)), ["s_suppkey"]).select("s_suppkey", "calls", "note")


@query("cache_key", """
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'multi|site.example|a‖b|임플란트|' ELSE 'site.example|solo||' END AS cache_key FROM supplier""")
def cache_key(spark, sf):
    key = measurement.cache_key(F.lit("site.example"), F.col("regions"), F.col("procedure"), F.col("query_fp"))
    return _planned(spark, sf).select("s_suppkey", key.alias("cache_key"))


# --- limits --------------------------------------------------------------------------------------

def _requests(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), "ts", F.col("user_id").cast("string").alias("ip_hash"),
        F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("cache_key"),
    )


@query("daily_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_counts(spark, sf):
    return limits.daily_counts(_requests(spark, sf))


@query("daily_counts_by_ip", "SELECT CAST(user_id AS VARCHAR) AS ip_hash, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_counts_by_ip(spark, sf):
    return limits.daily_counts(_requests(spark, sf), ["ip_hash"])


@query("cap_decisions", """
WITH a AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) AS ip_no FROM events),
g AS (SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS global_no FROM a WHERE ip_no <= 2)
SELECT a.event_id AS request_id, ip_no, global_no, CASE WHEN ip_no > 2 THEN 'ip-blocked' WHEN global_no > 150 THEN 'global-blocked' ELSE 'allowed' END AS decision
FROM a LEFT JOIN g USING (event_id)""")
def cap_decisions(spark, sf):
    return limits.cap_decisions(_requests(spark, sf), 2, 150).select("request_id", "ip_no", "global_no", "decision")


@query("reuse_decisions", """
WITH RECURSIVE r AS (SELECT 'k' || (user_id % 20) AS k, epoch_us(ts) AS us, event_id FROM events),
first_(k, us) AS (SELECT k, min(us) FROM r GROUP BY k),
chain(k, us) AS (
  SELECT k, us FROM first_
  UNION ALL
  SELECT c.k, (SELECT min(n.us) FROM r n WHERE n.k = c.k AND n.us > c.us + 86400000000) FROM chain c
  WHERE EXISTS (SELECT 1 FROM r n WHERE n.k = c.k AND n.us > c.us + 86400000000)),
starts AS (SELECT r.k, r.us, min(event_id) AS event_id FROM r JOIN chain USING (k, us) GROUP BY ALL)
SELECT r.event_id AS request_id, CASE WHEN s.event_id IS NOT NULL THEN 'run' ELSE 'reuse' END AS decision
FROM r LEFT JOIN starts s ON s.event_id = r.event_id""")
def reuse_decisions(spark, sf):
    return limits.reuse_decisions(_requests(spark, sf)).select("request_id", "decision")


# --- streams against their batch twins -----------------------------------------------------------

_FILES = 4
_ROWS_PER_FILE = 20_000
_PAGES_PER_FILE = 500


def _stream(spark, sf, name, order="ts", closing=False):
    """The table as a stream of four micro-batches in time order; rows inside a batch are in no order.

    A batch is a set of files that grows with the table, each written by its own task. `closing` adds a batch with one
    row, NULL but for a time far ahead: it opens a window of its own and closes all others.
    """
    rows = table(spark, sf, name)
    if order == "ts":
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
        at = F.unix_seconds("ts")
        low, high = rows.agg(F.min(at), F.max(at)).first()
        cut = F.least(F.floor((at - low) * _FILES / max(high - low, 1)), F.lit(_FILES - 1)) + 1
    else:
        cut = F.pmod(F.col(order), F.lit(_FILES)) + 1
    stream, folder = _batches(spark, rows.withColumn("_file", cut))
    if closing:
        ahead = (F.lit(high) + 10 * 365 * 86400).cast("timestamp")
        mark = spark.range(1).select(*[(ahead if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
        mark.write.mode("append").parquet(folder)
    return stream


def _batches(spark, rows, per_file=_ROWS_PER_FILE):
    """(stream, folder): the rows of each `_file`, 1 to four, as one micro-batch."""
    folder = f"{run_folder(spark)}/in"
    counts = {r["_file"]: r["n"] for r in rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()}
    files = max(1, min(counts.values(), default=1) // per_file)
    for k in sorted(counts):
        part = rows.where(F.col("_file") == k).drop("_file")
        part.repartition(files).write.mode("append").parquet(folder)
    schema = rows.drop("_file").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder), folder


def _drain(stream, keys, mode="update"):
    """Run a stream to its end. Every batch becomes a folder, written again on a retry; of a key's rows the newest counts."""
    folder = run_folder(stream.sparkSession)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = (
        stream.writeStream.foreachBatch(keep).outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    out = stream.sparkSession.read.parquet(f"{folder}/out")
    names = [c for c in out.columns if c not in (*keys, "batch")]
    newest = out.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")


@query("stream_daily_counts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf):
    from ..streaming.counters import daily_counts as stream_counts

    return _drain(stream_counts(_stream(spark, sf, "events")), ["day"])


@query("stream_daily_counts_by_ip", "SELECT substring(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS ip_hash, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts_by_ip(spark, sf):
    from ..streaming.counters import daily_counts_by_ip as stream_counts

    return _drain(stream_counts(_stream(spark, sf, "events"), "user_id"), ["ip_hash", "day"])


@query("stream_running_panel", f"""WITH {beds.RUNS}
SELECT site, engine, count(*) AS attempts, count(*) FILTER (status = 'valid') AS valid_runs, count(*) FILTER (status = 'valid' AND cited) AS cited_runs FROM runs GROUP BY ALL""")
def stream_running_panel(spark, sf):
    from ..streaming.counters import running_panel

    outcomes = beds.runs_of(_stream(spark, sf, "events"))
    rows = _drain(running_panel(outcomes, ["site"], window="365 days"), ["site", "engine", "window_start"])
    return rows.groupBy("site", "engine").agg(
        F.sum("attempts").alias("attempts"), F.sum("valid_runs").alias("valid_runs"), F.sum("cited_runs").alias("cited_runs")
    )


@query("stream_panel", f"""WITH {beds.RUNS},
p AS (SELECT site, engine, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, prompt, count(*) AS attempts, count(*) FILTER (status = 'valid') AS valid,
  count(*) FILTER (status = 'valid' AND cited) AS cited FROM runs GROUP BY ALL),
e AS (SELECT site, engine, week, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(valid) AS BIGINT) AS valid_runs, CAST(sum(cited) AS BIGINT) AS cited_runs, count(*) FILTER (valid > 0) AS prompts_scored,
  count(*) FILTER (valid > 0 AND cited = valid) AS always_cited, count(*) FILTER (valid > 0 AND cited = 0) AS never_cited FROM p GROUP BY ALL)
SELECT *, round(1 - CAST(abs(always_cited - never_cited) AS DOUBLE) / nullif(prompts_scored, 0), 2) AS spread FROM e""")
def stream_panel(spark, sf):
    """Closed weeks: engine rows with their distribution over prompts, by two aggregations in a chain."""
    from ..streaming.counters import closed_panel

    outcomes = beds.runs_of(_stream(spark, sf, "events", closing=True))
    rows = _drain(closed_panel(outcomes, ["site"], window="7 days"), ["site", "engine", "window_start"], "append")
    return rows.select(
        "site", "engine", F.floor(F.unix_seconds("window_start") / 604800).alias("week"), "attempts", "valid_runs", "cited_runs",
        "prompts_scored", "always_cited", "never_cited", "spread",
    )


def _request_stream(spark, sf):
    return _stream(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), "ts", F.col("user_id").cast("string").alias("ip_hash"),
        F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("cache_key"),
    )


@query("stream_caps", SQL["cap_decisions"])
def stream_caps(spark, sf):
    """Decided batch by batch; rows late by more than two days would be in `late`, and miss here."""
    from ..streaming import decisions

    folder = run_folder(spark)
    writer = decisions.cap_decisions(_request_stream(spark, sf), folder, f"{folder}/checkpoint", 2, 150)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/decided").select("request_id", "ip_no", "global_no", "decision")


@query("stream_reuse", SQL["reuse_decisions"])
def stream_reuse(spark, sf):
    from ..streaming import decisions

    return _drain(decisions.reuse_decisions(_request_stream(spark, sf)), ["request_id"], "append").select("request_id", "decision")


@query("stream_latest", """
SELECT user_id AS site, event_id AS record_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS hist_no FROM events QUALIFY hist_no <= 30""")
def stream_latest(spark, sf):
    from ..streaming.state import latest_30_state

    records = _stream(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("site"), "ts", F.col("event_id").alias("record_id"), (F.col("event_id") % 101).alias("score")
    )
    rows = _drain_lists(latest_30_state(records, days=3650))
    return rows.select(F.col("site").cast("bigint").alias("site"), "record_id", "hist_no")


def _drain_lists(stream):
    """Each batch sends the whole list of every site that changed: the newest batch of a site counts."""
    folder = run_folder(stream.sparkSession)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    out = stream.sparkSession.read.parquet(f"{folder}/out")
    last = out.groupBy("site").agg(F.max("batch").alias("_last"))
    return out.join(last, "site").where(F.col("batch") == F.col("_last"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


@query("stream_audit", f"""WITH {AUDIT}, s AS (
  SELECT page_id, regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, CASE length({_HOST}) % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'ok' ELSE 'warn' END AS crawl,
    tech_score - 11 + content_score + CASE length({_HOST}) % 3 WHEN 0 THEN 2 WHEN 1 THEN 15 ELSE 11 END AS score FROM audited)
SELECT page_id, domain, crawl, score, score - lag(score) OVER (PARTITION BY domain ORDER BY page_id % {_FILES}, page_id) AS delta FROM s""")
def stream_audit(spark, sf):
    """Pages arrive in four batches, each with the robots answers of its hosts and hours; a page's time is its batch, then its number."""
    from ..sources.readers import with_host
    from ..streaming.audit import stream_audit as audited

    folder = run_folder(spark)
    batch = F.pmod(F.col("page_id"), F.lit(_FILES))
    pages = table(spark, sf, "pages").select(
        "page_id", "url", F.timestamp_seconds(1_700_000_000 + batch * 10_000_000 + F.col("page_id")).alias("ts"), "html", (batch + 1).alias("_file")
    )
    kind = F.length("host") % 3
    rule = F.when(kind == 0, "Disallow: /").otherwise("Allow: /")
    answers = with_host(pages).select("host", F.date_trunc("hour", "ts").alias("ts"), "_file").distinct().select(
        "host", "ts", F.when(kind == 2, 404).otherwise(200).alias("status"), F.lit("text/plain").alias("content_type"),
        F.concat(F.lit("User-agent: *\n"), rule).alias("body"), "_file",
    )
    writer = audited(_batches(spark, pages, _PAGES_PER_FILE)[0], folder, f"{folder}/checkpoint", _batches(spark, answers)[0])
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/score")
    return rows.select("page_id", "domain", "crawl", F.col("score").cast("bigint").alias("score"), F.col("delta").cast("bigint").alias("delta"))
