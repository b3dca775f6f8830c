"""Readers and sinks: the tables are written in the formats the readers know, and read back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.storage import run_folder
from ..operators import funnel, history, notes, panel, views
from ..operators.responses import as_response
from ..plans.citation import outcomes_of
from ..sources import dimensions, history_store, readers, sinks
from . import beds
from .core import page_table, query, table

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


_ROWS_PER_FILE = 500


def _file_of(df, key):
    """Number of the file a row goes to: as many files as hold about _ROWS_PER_FILE rows each, whatever the table holds."""
    return F.pmod(F.xxhash64(key), F.lit(max(4, -(-df.count() // _ROWS_PER_FILE))))


def _one_file_each(df, path, kind):
    """`df` has one row per `k`: every row becomes a file of its own."""
    getattr(df.write.partitionBy("k"), kind)(path)


@query("read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def read_pages(spark, sf):
    folder = f"{run_folder(spark)}/pages"
    page_table(spark, sf).write.parquet(folder)
    return readers.read_pages(spark, folder).select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query("read_robots", f"""WITH r AS (
  SELECT {_HOST} AS host, CASE WHEN page_id % 3 = 0 THEN 200 ELSE 404 END AS status, 'User-agent: *' || chr(10) || 'Disallow: /p' || page_id AS body FROM pages)
SELECT host, status, body FROM r QUALIFY row_number() OVER (PARTITION BY host ORDER BY status = 200 DESC, body DESC) = 1""")
def read_robots(spark, sf):
    n = F.col("page_id")
    answers = readers.with_host(page_table(spark, sf)).select(
        "host", F.when(n % 3 == 0, 200).otherwise(404).alias("status"), F.lit("text/plain").alias("content_type"),
        F.concat(F.lit("User-agent: *\nDisallow: /p"), n.cast("string")).alias("body"),
    )
    folder = f"{run_folder(spark)}/robots"
    answers.write.json(folder)
    return readers.read_robots(spark, folder).select("host", "status", "body")


_TOOL_ERROR = '{"content":[{"type":"tool_result","is_error":true,"content":[{"type":"text","text":"max uses"}]}]}'


@query("read_engine_responses", f"""WITH {beds.URL_RUNS}, r AS (SELECT DISTINCT run_ord, engine FROM cites), k AS (
  SELECT *, run_ord % 6 AS kind FROM r)
SELECT run_ord, engine, CASE WHEN kind = 4 OR kind = 3 AND engine = 'claude' THEN 'error' WHEN kind IN (1, 2) THEN 'inconclusive' ELSE 'valid' END AS status,
  CASE WHEN kind = 4 THEN 'HTTP 500' WHEN kind = 3 AND engine = 'claude' THEN 'claude: web_search_tool_result error — max uses' END AS error,
  kind = 1 OR kind = 2 OR kind = 4 OR kind = 3 AND engine = 'claude' AS silent FROM k""")
def read_engine_responses(spark, sf):
    """Empty, malformed and failed responses among sound ones."""
    kind = F.col("run_ord") % 6
    sound = as_response("engine", "urls", F.concat(F.lit("answer "), F.col("run_ord").cast("string")))
    response = (
        F.when(kind == 1, "").when(kind == 2, "{bad").when(kind == 4, F.lit(None).cast("string"))
        .when((kind == 3) & (F.col("engine") == "claude"), _TOOL_ERROR).otherwise(sound)
    )
    log = beds.url_runs(spark, sf).select(
        "run_ord", "site", "engine", "prompt", F.array(F.lit("answer 1")).alias("names"), response.alias("response"),
        F.when(kind == 4, "HTTP 500").alias("error"),
    )
    folder = f"{run_folder(spark)}/responses"
    log.write.json(folder)
    rows = outcomes_of(readers.read_engine_responses(spark, folder))
    return rows.select("run_ord", "engine", "status", "error", (F.col("answer") == "").alias("silent"))


@query("read_bot_hits", """
SELECT CASE user_id % 3 WHEN 0 THEN 'OAI-SearchBot' WHEN 1 THEN 'ClaudeBot' ELSE 'id:999' END AS bot, sum(event_id % 7) AS hits FROM events GROUP BY ALL""")
def read_bot_hits(spark, sf):
    number = F.element_at(F.array(*[F.lit(x) for x in (126255384, 33563859, 999)]), (F.col("user_id") % 3 + 1).cast("int")).cast("bigint")
    group = F.struct(
        F.sum(F.col("event_id") % 7).alias("count"),
        F.struct(F.array(F.first(number)).alias("botDetectionIds"), F.lit("/").alias("clientRequestPath"), F.lit("x").alias("userAgent")).alias("dimensions"),
    )
    groups = table(spark, sf, "events").groupBy("user_id").agg(group.alias("g"))
    zone = F.struct(F.collect_list("g").alias("httpRequestsAdaptiveGroups"))
    reports = groups.groupBy(_file_of(groups, "user_id").alias("k")).agg(zone.alias("z"))
    data = reports.select("k", F.struct(F.struct(F.array("z").alias("zones")).alias("viewer")).alias("data"))
    folder = f"{run_folder(spark)}/bots"
    _one_file_each(data, folder, "json")
    return funnel.bot_hits_by_bot(readers.read_bot_hits(spark, folder)).select("bot", "hits")


@query("read_field_notes", """
SELECT title, CASE page_id % 2 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence, 'r' || page_id % 4 AS reviewed_at
FROM (SELECT page_id, 'note ' || page_id AS title FROM pages) WHERE page_id % 5 > 0""")
def read_field_notes(spark, sf):
    n = F.col("page_id")
    note = F.struct(
        F.concat(F.lit("note "), n.cast("string")).alias("title"), F.when(n % 5 == 0, "ftp://x").otherwise(F.col("url")).alias("url"),
        F.lit("s").alias("summary"), F.when(n % 2 == 0, "high").otherwise("medium").alias("confidence"),
    )
    pages = page_table(spark, sf)
    reviewed = F.concat(F.lit("r"), (n % 4).cast("string"))
    by_file = pages.groupBy(_file_of(pages, "page_id").alias("_f"), reviewed.alias("reviewedAt")).agg(F.collect_list(note).alias("notes"))
    files = by_file.select("reviewedAt", "notes", F.concat("reviewedAt", F.lit("-"), F.col("_f").cast("string")).alias("k"))
    folder = f"{run_folder(spark)}/notes"
    _one_file_each(files, folder, "json")
    found, _ = readers.read_field_notes(spark, folder)
    return notes.valid_notes(found).select("title", "confidence", "reviewed_at")


@query("read_feed_items", """
SELECT 'feed' AS feed, source || ' item ' || doc_id AS title, 'https://f.example/' || doc_id AS url, 'd' || doc_id % 9 AS date,
  row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) - 1 AS item_no FROM documents""")
def read_feed_items(spark, sf):
    """Items of 500 neighbouring documents stand in one file, in the order of their ids."""
    d = F.col("doc_id").cast("string")
    item = F.concat(
        F.lit("<item><title> "), "source", F.lit(" item "), d, F.lit("</title><link>https://f.example/"), d,
        F.lit("</link><pubDate>d"), (F.col("doc_id") % 9).cast("string"), F.lit("</pubDate></item>"),
    )
    numbered = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / _ROWS_PER_FILE).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("_items")
    )
    files = numbered.select("k", F.concat(F.lit("<rss><channel>"), F.array_join("_items.item", ""), F.lit("</channel></rss>")).alias("value"))
    folder = f"{run_folder(spark)}/feeds"
    _one_file_each(files, folder, "text")
    return readers.read_feed_items(spark, folder, "feed").select("feed", "title", "url", "date", "item_no")


@query("append_history", """
SELECT o_custkey AS domain, o_orderkey AS record_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-01'""")
def append_history(spark, sf):
    folder = run_folder(spark)
    rows = beds.history(spark, sf).withColumnRenamed("site", "domain")
    for k in range(2):
        part = rows.where(F.col("record_id") % 2 == k)
        sinks.append_history(part.repartition(4 * spark.sparkContext.defaultParallelism, F.to_date("ts")), folder, "score")
    return sinks.read_history(spark, folder, "score", F.lit("1997-06-01").cast("date")).select("domain", "record_id", "day")


@query("upsert_monthly", """
SELECT o_custkey AS domain, strftime(o_orderdate, '%Y-%m') AS period, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS record_id FROM orders GROUP BY ALL""")
def upsert_monthly(spark, sf):
    """Written twice: the second write meets the months of the first."""
    saved = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey"))
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("domain"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderkey").alias("record_id"), saved.alias("saved_at")
    )
    folder = f"{run_folder(spark)}/monthly"
    for k in range(2):
        sinks.upsert_monthly(rows.where(F.col("record_id") % 2 == k), folder)
    return sinks.read_monthly(spark, folder).select("domain", "period", "record_id")


@query("append_leads", """WITH l AS (
  SELECT c_custkey AS k, c_custkey % 2 = 0 AS public, c_custkey % 10 = 0 AS unnamed, c_custkey % 3 = 0 AS bad_mail, c_custkey % 7 = 0 AS no_contact FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY public, (k * 11) // 60, k % 4 ORDER BY k) > 5 AS limited FROM l),
j AS (SELECT CASE WHEN public AND limited THEN 'rate-limited' WHEN unnamed THEN 'missing-clinicName' WHEN public AND bad_mail THEN 'invalid-email'
  WHEN NOT public AND no_contact THEN 'missing-contactName' END AS reason FROM n)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS leads FROM j GROUP BY ALL""")
def append_leads(spark, sf):
    k = F.col("c_custkey")
    leads = table(spark, sf, "customer").select(
        F.when(k % 2 == 0, "public").otherwise("").alias("source"), F.lit("").alias("domain"), F.when(k % 10 > 0, F.col("c_name")).otherwise(" ").alias("clinic_name"),
        F.when(k % 7 > 0, "kim").alias("contact_name"), F.lit("010").alias("phone"), F.when(k % 3 > 0, "a@b.example").otherwise("bad").alias("email"),
        F.array(F.lit("p")).alias("selected_products"), F.lit("").alias("notes"), F.lit(1.0).alias("geo_score"), F.lit(True).alias("ai_cited"),
        k.alias("request_id"), F.timestamp_seconds(k * 11 * 60).alias("ts"), (k % 4).cast("string").alias("ip_hash"),
    )
    folder = run_folder(spark)
    limited = sinks.limit_leads(leads).drop("request_id", "ts", "ip_hash")
    sinks.append_leads(limited, folder, F.lit("2026-01-05").cast("timestamp"))
    good = spark.read.parquet(f"{folder}/accepted").select(F.lit("accepted").alias("reason"))
    bad = spark.read.parquet(f"{folder}/rejected").select(F.col("reject_reason").alias("reason"))
    return good.unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("leads"))


@query("write_reports", f"""WITH {beds.ENGINE}
SELECT view, count(*) AS panels, sum(valid_runs)::BIGINT AS valid_runs, view = 'private' AS has_rivals FROM engine_panel, (SELECT unnest(['public', 'private']) AS view) GROUP BY view""")
def write_reports(spark, sf):
    by_engine = panel.panel_by_engine(beds.runs(spark, sf), beds.KEYS)
    rivals = by_engine.select(*beds.KEYS, "engine", F.lit(1).alias("domain_ord"), F.lit("rival.example").alias("domain"))
    folder = run_folder(spark)
    sinks.write_reports(views.public_view(by_engine, beds.KEYS), views.private_view(by_engine, rivals, beds.KEYS), folder)
    out = None
    for view in ("public", "private"):
        rows = spark.read.parquet(f"{folder}/{view}")
        part = rows.groupBy("view").agg(F.count(F.lit(1)).alias("panels"), F.sum("valid_runs").alias("valid_runs")).withColumn(
            "has_rivals", F.lit("compare_candidates" in rows.columns)
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("compacted_history", f"""WITH {beds.HISTORY}
SELECT site AS domain, record_id, score, score - lag(score) OVER (PARTITION BY site ORDER BY ts, record_id) AS delta,
  row_number() OVER (PARTITION BY site ORDER BY ts DESC, record_id DESC) AS newest_no FROM history WHERE ts < TIMESTAMP '2001-08-01'""")
def compacted_history(spark, sf):
    """Day folders moved into buckets by domain in two rounds; differences and ranks read the buckets where they lie."""
    folder = run_folder(spark)
    name = "history_" + folder.rsplit("-", 1)[-1]
    rows = beds.history(spark, sf).withColumnRenamed("site", "domain")
    for low, high in (("1995-01-01", "1998-01-01"), ("1998-01-01", "2001-08-02")):
        part = rows.where((F.col("ts") >= low) & (F.col("ts") < high))
        sinks.append_history(part.repartition(4 * spark.sparkContext.defaultParallelism, F.to_date("ts")), folder, "score")
        history_store.compact_history(spark, folder, "score", name, F.lit(high).cast("date"), buckets=8)
    moved = history_store.compacted_history(spark, folder, "score", name)
    looked = history.score_delta(moved, ["domain"], tiebreak=["record_id"], slice_unit=None)
    order = [F.col("ts").desc(), F.col("record_id").desc()]
    numbered = looked.withColumn("newest_no", F.row_number().over(Window.partitionBy("domain").orderBy(*order)).cast("bigint"))
    return numbered.select("domain", "record_id", "score", "delta", "newest_no")


@query("dimensions", f"""WITH {beds.RUNS}
SELECT engine, count(*) AS runs, 'auto-api' AS measure_mode FROM runs GROUP BY engine""")
def dimension_join(spark, sf):
    counts = beds.runs(spark, sf).groupBy("engine").agg(F.count(F.lit(1)).alias("runs"))
    return counts.join(dimensions.dim_engine(spark).select("engine", "measure_mode"), "engine")


def _values(rows, names):
    """Fixed values as SQL rows."""
    def text(v):
        return "[" + ", ".join(map(text, v)) + "]" if isinstance(v, list | tuple) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


_DIMENSIONS = {
    "bot": (dimensions.dim_bot, ["token", "category"]),
    "detection": (dimensions.dim_bot_detection, ["bot", "detection_id"]),
    "checklist": (dimensions.dim_checklist, ["checklist", "item_id"]),
    "procedure": (dimensions.dim_procedure, ["q", "label"]),
    "follow_up": (dimensions.dim_follow_up, ["product_id", "rule"]),
    "sido": (dimensions.dim_sido, ["spelling", "short"]),
    "region_term": (dimensions.dim_region_term, ["term", "term"]),
    "score_item": (dimensions.dim_score_item, ["key", "axis"]),
}
_DIMENSION_ROWS = [
    *[("bot", t, c) for t, _, c in K.BOTS], *[("detection", b, str(i)) for b, ids in K.BOT_DETECTION_IDS for i in ids],
    *[("checklist", c, i) for c, i, *_ in K.CHECKLIST_ITEMS], *[("procedure", q, label) for q, label, _ in K.PROCEDURES],
    *[("follow_up", p, r) for p, r in K.FOLLOW_UPS], *[("sido", s, x) for s, x in K.SIDO], *[("region_term", t, t) for t in K.REGION_TERMS],
    *[("score_item", row[0], row[4]) for row in K.SCORE_ITEMS],
]


@query("dimension_lookups", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY k, v) - 1 AS no, count(*) OVER (PARTITION BY dimension) AS n
  FROM {_values(_DIMENSION_ROWS, 'dimension, k, v')})
SELECT d.dimension, d.k AS key, d.v AS value, count(*) AS events FROM events e JOIN d ON e.event_id % d.n = d.no GROUP BY ALL""")
def dimension_lookups(spark, sf):
    """All eight small dimensions as lookup tables of a fact table: events per entry."""
    e = table(spark, sf, "events")
    out = None
    for name, (build, (key, value)) in _DIMENSIONS.items():
        entries = build(spark).select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
        numbered = sorted(tuple(r) for r in entries.collect())
        lookup = spark.createDataFrame([(i, *r) for i, r in enumerate(numbered)], "no bigint, key string, value string")
        counts = e.groupBy((F.col("event_id") % len(numbered)).alias("no")).agg(F.count(F.lit(1)).alias("events"))
        part = counts.join(lookup, "no").select(F.lit(name).alias("dimension"), "key", "value", "events")
        out = part if out is None else out.unionByName(part)
    return out
