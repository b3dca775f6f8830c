"""Readers. Schemas are given, never inferred, so a read plans without a pass over data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, text_or_empty
from ..functions.urls import url_host
from ..operators.funnel import keep_ai_sessions
from ..operators.places import normalize_places

PAGE_SCHEMA = (
    "url string, final_url string, status int, content_type string, html string, "
    "redirect_chain array<string>, headers map<string,string>"
)
ROBOTS_SCHEMA = "host string, status int, content_type string, body string"
RESPONSE_SCHEMA = (
    "run_id bigint, run_ord bigint, ts timestamp, site string, names array<string>, region string, "
    "procedure string, engine string, prompt string, rep int, response string, error string"
)
_VALUES = "array<struct<value:string>>"
SESSION_SCHEMA = f"rows array<struct<dimensionValues:{_VALUES},metricValues:{_VALUES}>>"
BOT_SCHEMA = (
    "data struct<viewer:struct<zones:array<struct<httpRequestsAdaptiveGroups:array<struct<count:bigint,"
    "dimensions:struct<botDetectionIds:array<bigint>,clientRequestPath:string,userAgent:string>>>>>>>"
)
PLACE_ITEM = (
    "struct<id:string,name:string,category:string,address:string,roadAddress:string,phone:string,"
    "x:string,y:string,visitorReviewCount:string,blogCafeReviewCount:string,bookingReviewCount:string,"
    "imageCount:string,businessHours:string>"
)
PLACE_SCHEMA = f"query string, start int, total bigint, items array<{PLACE_ITEM}>"
NOTES_SCHEMA = (
    "reviewedAt string, updatedAt string, "
    "notes array<struct<title:string,url:string,source:string,date:string,summary:string,"
    "clientAction:string,confidence:string>>, "
    "benchmarks array<struct<label:string,metric:string,asOf:string,note:string,sampleNote:string>>"
)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: a crawl snapshot, or (`fmt='text'`) one HTML file per page, its path as URL."""
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        return files.select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    reader = spark.read if fmt == "parquet" else spark.read.schema(PAGE_SCHEMA)
    return reader.format(fmt).load(path)


def read_robots(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A2: one robots.txt answer per host. Several answers of a host: one read as 200 wins, then the largest by content."""
    rows = spark.read.schema(ROBOTS_SCHEMA).format(fmt).load(path)
    body = F.struct(*[c for c in rows.columns if c != "host"])
    rank = F.struct((F.col("status") == 200).cast("int"), "body", "content_type", "status")
    one = rows.groupBy("host").agg(F.max_by(body, rank).alias("_r"))
    return one.select("host", "_r.*")


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("host", url_host(url))


def with_robots(pages: DataFrame, summary: DataFrame, host: str = "host") -> DataFrame:
    """Left join of the per-host summary as struct `robots`.

    One summary row per host: Spark broadcasts it when its measured size is below the threshold,
    otherwise AQE splits the pages of a host that holds a large share.
    """
    packed = summary.select(host, F.struct(*[c for c in summary.columns if c != host]).alias("robots"))
    return pages.join(packed, host, "left")


def read_engine_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A3: one row per run; the raw response stays text."""
    return spark.read.schema(RESPONSE_SCHEMA).format(fmt).load(path)


def ai_session_rows(reports: DataFrame) -> DataFrame:
    """A4: report rows -> (date, source_medium, sessions, users, key_events)."""
    rows = reports.select(F.explode("rows").alias("r"))

    def dimension(i: int) -> Column:
        return F.get(F.col("r.dimensionValues"), F.lit(i))["value"]

    def metric(i: int) -> Column:
        number = F.get(F.col("r.metricValues"), F.lit(i))["value"].try_cast("double")
        return F.coalesce(number, F.lit(0.0)).cast("bigint")

    source = dimension(0)
    return rows.select(
        dimension(1).alias("date"),
        F.when(text_or_empty(source) != "", source).otherwise("(unknown)").alias("source_medium"),
        strip(F.substring_index(source, "/", -1)).alias("medium"),
        metric(0).alias("sessions"), metric(1).alias("users"), metric(2).alias("key_events"),
    )


def read_ai_sessions(spark: SparkSession, path: str) -> DataFrame:
    return keep_ai_sessions(ai_session_rows(spark.read.schema(SESSION_SCHEMA).json(path, multiLine=True)))


def bot_hit_rows(reports: DataFrame) -> DataFrame:
    """A5: the groups of the first zone -> (count, detection_ids, path, user_agent)."""
    zone = F.get(F.col("data.viewer.zones"), F.lit(0))
    groups = reports.select(F.explode(zone["httpRequestsAdaptiveGroups"]).alias("g"))
    return groups.select(
        F.coalesce("g.count", F.lit(0)).alias("count"),
        F.col("g.dimensions.botDetectionIds").alias("detection_ids"),
        F.col("g.dimensions.clientRequestPath").alias("path"), F.col("g.dimensions.userAgent").alias("user_agent"),
    )


def read_bot_hits(spark: SparkSession, path: str, mode: str = "precise") -> DataFrame:
    hits = bot_hit_rows(spark.read.schema(BOT_SCHEMA).json(path, multiLine=True))
    return hits.drop("user_agent") if mode == "precise" else hits.drop("detection_ids", "path")


def place_rows(results: DataFrame) -> DataFrame:
    """One row per listing, rank counted on from `start`."""
    rows = results.select(
        "query", "total", F.coalesce("start", F.lit(1)).alias("_start"), F.posexplode("items").alias("_i", "_item")
    )
    ranked = rows.select("query", "total", (F.col("_start") + F.col("_i")).alias("rank"), "_item.*")
    return normalize_places(ranked)


def read_place_results(spark: SparkSession, path: str) -> DataFrame:
    return place_rows(spark.read.schema(PLACE_SCHEMA).json(path))


def read_field_notes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(notes, benchmarks), each with reviewed_at; validate with `operators.notes`."""
    raw = spark.read.schema(NOTES_SCHEMA).json(path, multiLine=True)
    reviewed = F.coalesce("reviewedAt", "updatedAt", F.lit("")).alias("reviewed_at")
    notes = raw.select(reviewed, F.inline("notes")).withColumnRenamed("clientAction", "client_action")
    marks = raw.select(reviewed, F.inline("benchmarks")).withColumnsRenamed(
        {"asOf": "as_of", "sampleNote": "sample_note"}
    )
    return notes, marks


_ITEM = r"(?s)<(item|entry)(?:\s[^>]*)?>.*?</\1\s*>"
_LINK = "link array<struct<_href:string,_rel:string,_VALUE:string>>"


def read_feed_items(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """RSS items and Atom entries of one feed -> title, url, date, file, item_no.

    `item_no` is the item's place in its file, so order and first k don't depend on how files are split or read. A feed file is
    read as a whole by one task; many files are many tasks. Of several Atom links the first that isn't a relation
    other than "alternate" counts.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    found = files.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(_ITEM), F.lit(0))).alias("item_no", "_xml"))
    item = F.from_xml(F.col("_xml"), f"title string, {_LINK}, pubDate string, updated string")
    rows = found.select("file", F.col("item_no").cast("bigint").alias("item_no"), item.alias("_i"))
    links = F.filter("_i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.get(links, F.lit(0))
    cleaned = rows.select(
        F.lit(feed).alias("feed"), strip("_i.title").alias("title"), strip(F.coalesce(link["_href"], link["_VALUE"])).alias("url"),
        strip(text_or_empty(F.coalesce("_i.pubDate", "_i.updated"))).alias("date"), "file", "item_no",
    )
    return cleaned.where((text_or_empty("title") != "") & (text_or_empty("url") != ""))
