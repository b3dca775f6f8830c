"""Test beds: driver tables mapped to the inputs of the operators, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .core import dealt, table

KEYS = ["site", "region", "procedure"]


# --- runs from events -------------------------------------------------------------------------

def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is one engine run."""
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(e: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "signup", "inconclusive").otherwise("valid")
    return e.select(
        F.concat(F.lit("site"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("site"),
        F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("region"),
        F.lit("p").alias("procedure"),
        F.element_at(F.array(*[F.lit(x) for x in K.AUTO_ENGINES]), (F.col("event_id") % 3 + 1).cast("int")).alias("engine"),
        F.concat(F.lit("prompt "), (k % 4).cast("string")).alias("prompt"),
        F.col("event_id").alias("run_ord"), "ts", status.alias("status"),
        (kind == "purchase").alias("cited"), (kind == "click").alias("named"),
        F.when((kind == "purchase"), F.element_at(F.array(F.lit("top"), F.lit("mid"), F.lit("tail")), k % 3 + 1)).alias("position"),
        F.when(kind == "error", F.lit("HTTP 500")).alias("error"),
    )


RUNS = """
runs AS (
  SELECT 'site' || user_id || '.example.com' AS site, 'r' || (user_id % 5) AS region, 'p' AS procedure,
         CASE event_id % 3 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' ELSE 'perplexity' END AS engine,
         'prompt ' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4) AS prompt,
         event_id AS run_ord, ts,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'inconclusive' ELSE 'valid' END AS status,
         event_type = 'purchase' AS cited, event_type = 'click' AS named,
         CASE WHEN event_type = 'purchase' THEN CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3
              WHEN 0 THEN 'top' WHEN 1 THEN 'mid' ELSE 'tail' END END AS position
  FROM events)
"""

# counts per prompt and per engine, the wilson interval written out
PROMPTS = RUNS + """,
prompts AS (
  SELECT site, region, procedure, engine, prompt,
         count(*) AS attempts,
         count(*) FILTER (status = 'error') AS errored,
         count(*) FILTER (status = 'inconclusive') AS inconclusive,
         count(*) FILTER (status = 'valid') AS valid,
         count(*) FILTER (status = 'valid' AND cited) AS cited,
         count(*) FILTER (status = 'valid' AND named) AS named,
         min(run_ord) AS first_ord
  FROM runs GROUP BY ALL)
"""
ENGINE = RUNS + """,
counted AS (
  SELECT site, region, procedure, engine,
         count(*) AS attempts,
         count(*) FILTER (status = 'valid') AS valid_runs,
         count(*) FILTER (status = 'valid' AND cited) AS cited_runs,
         count(*) FILTER (status <> 'error' AND named) AS named_runs,
         count(*) FILTER (status = 'error') AS errored_runs,
         count(*) FILTER (status = 'inconclusive') AS inconclusive_runs,
         count(*) FILTER (status = 'valid' AND cited AND position = 'top') AS pos_top,
         count(*) FILTER (status = 'valid' AND cited AND position = 'mid') AS pos_mid,
         count(*) FILTER (status = 'valid' AND cited AND position = 'tail') AS pos_tail
  FROM runs GROUP BY ALL),
rates AS (
  SELECT *, CAST(cited_runs AS DOUBLE) / nullif(valid_runs, 0) AS p, CAST(valid_runs AS DOUBLE) AS n FROM counted),
engine_panel AS (
  SELECT site, region, procedure, engine, attempts, valid_runs, cited_runs, named_runs, errored_runs,
         inconclusive_runs, pos_top, pos_mid, pos_tail,
         coalesce(round(p, 2), 0.0) AS hit_rate, cited_runs > 0 AS cited,
         cited_runs > 0 OR named_runs > 0 AS exposed,
         CASE WHEN cited_runs > 0 AND valid_runs >= 2 THEN greatest(0.0, round(
           ((p + 3.8416 / (2 * n)) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 3)) END AS ci_low,
         CASE WHEN cited_runs > 0 AND valid_runs >= 2 THEN least(1.0, round(
           ((p + 3.8416 / (2 * n)) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 3)) END AS ci_high,
         valid_runs > 0 AS measured,
         CASE WHEN valid_runs > 0 THEN NULL WHEN errored_runs > 0 THEN 'engine-error'
              WHEN inconclusive_runs > 0 THEN 'no-search' ELSE 'no-key' END AS unmeasurable
  FROM rates)
"""


# --- runs that cite page URLs -----------------------------------------------------------------

URLS_PER_RUN = 5


def url_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive pages are the citations of one run; three sites by turns."""
    p = table(spark, sf_dir, "pages")
    grouped = p.groupBy(F.floor(F.col("page_id") / URLS_PER_RUN).alias("run_ord")).agg(
        F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("_u")
    )
    third = (F.col("run_ord") % 3).cast("int") + 1

    def pick(*names: str) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), third)

    return grouped.select(
        F.col("run_ord").cast("bigint").alias("run_ord"),
        F.element_at(F.array(*[F.lit(x) for x in K.AUTO_ENGINES]), (F.col("run_ord") / 3 % 3 + 1).cast("int")).alias("engine"),
        pick("example.com", "example.net", "example.org").alias("site"),
        F.concat(F.lit("q"), (F.col("run_ord") % 4).cast("string")).alias("prompt"),
        F.transform("_u", lambda u: u["url"]).alias("urls"),
    )


URL_RUNS = r"""
cites AS (
  SELECT page_id // 5 AS run_ord, page_id, url,
         lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
         regexp_extract(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '([^.]+\.[^.]+)$', 1) AS domain,
         CASE (page_id // 5) % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'example.net' ELSE 'example.org' END AS site,
         CASE ((page_id // 5) // 3) % 3 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' ELSE 'perplexity' END AS engine,
         'q' || ((page_id // 5) % 4) AS prompt
  FROM pages)
"""


# --- score items from part --------------------------------------------------------------------

#: Parts and listings a task turns into many wide rows.
PER_TASK = 20_000


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", PER_TASK)


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_items_of(table(spark, sf_dir, "part"))


def part_items_of(p: DataFrame) -> DataFrame:
    """Nine items per part: points = (key * (7 * ord + 3)) mod (max + 1)."""
    rows = []
    for i, (key, label, top, layer, axis, why) in enumerate(K.SCORE_ITEMS):
        points = F.pmod(F.col("p_partkey") * (7 * i + 3), F.lit(top + 1)).cast("int")
        limited = (F.pmod(F.col("p_partkey"), F.lit(5)) == 0) & F.lit(axis == "content")
        status = F.when(points * 4 >= top * 3, "ok").when((points > 0) | limited, "warn").otherwise("fail")
        rows.append(F.struct(
            F.lit(i).alias("item_ord"), F.lit(key).alias("key"), F.lit(label).alias("label"),
            F.lit(layer).alias("layer"), F.lit(axis).alias("axis"), points.alias("points"), F.lit(top).alias("max"),
            status.alias("status"), F.concat(F.lit(key), F.lit(" "), points.cast("string")).alias("note"),
            F.when((status != "ok") & ~limited, F.concat(F.lit("fix "), F.lit(key))).alias("fix"),
            F.lit(why).alias("why"), F.when(limited, "limited").otherwise("measured").alias("measurement"),
        ))
    return p.select("p_partkey", F.array(*rows).alias("items"))


def _item_values() -> str:
    return ", ".join(
        f"({i}, '{key}', '{label}', {top}, '{layer}', '{axis}')"
        for i, (key, label, top, layer, axis, _) in enumerate(K.SCORE_ITEMS)
    )


ITEMS = f"""
dim_item(item_ord, key, label, max, layer, axis) AS (VALUES {_item_values()}),
raw_items AS (
  SELECT p_partkey, d.*, CAST((p_partkey * (7 * item_ord + 3)) % (max + 1) AS INT) AS points,
         p_partkey % 5 = 0 AND axis = 'content' AS limited
  FROM part CROSS JOIN dim_item d),
items AS (
  SELECT *, CASE WHEN points * 4 >= max * 3 THEN 'ok' WHEN points > 0 OR limited THEN 'warn' ELSE 'fail' END AS status,
         key || ' ' || points AS note
  FROM raw_items),
items_fix AS (
  SELECT *, CASE WHEN status <> 'ok' AND NOT limited THEN 'fix ' || key END AS fix FROM items)
"""


# --- signal rows from part --------------------------------------------------------------------

def part_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full signal row per part: each signal is the key modulo a different number."""
    p = parts(spark, sf_dir)
    k = F.col("p_partkey")

    def mod(m: int) -> Column:
        return (k % m).cast("int")

    return p.select(
        "p_partkey",
        (mod(11) == 0).alias("needs_render"), (mod(2) == 0).alias("has_dental"), (mod(3) == 0).alias("has_trust"),
        (mod(5) == 0).alias("has_faq"), (mod(7) == 0).alias("has_same_as_authority"), mod(3).alias("price_band"),
        (mod(10) / 100.0).cast("double").alias("sn"), mod(60).alias("scripts"), (mod(4) > 0).alias("phone"),
        (mod(9) > 3).alias("address"), mod(6).alias("credentials"), mod(8).alias("social"),
        mod(4).alias("date_signals"), mod(2).alias("h1_count"), mod(5).alias("h2_count"), mod(3).alias("question_h2"),
        mod(7).alias("tables"), mod(6).alias("faq_blocks"), (mod(13) > 6).alias("has_cited_sources"),
        (mod(17) > 8).alias("has_quotations"), mod(3).alias("stat_count"),
        F.when(
            mod(4) > 0,
            F.struct(
                F.lit(True).alias("present"), (mod(12) == 1).alias("blocks_any"),
                F.array(F.lit("PerplexityBot")).alias("blocked_citation"),
                F.when(mod(6) == 3, F.array(F.lit("CCBot"))).otherwise(F.array().cast("array<string>")).alias("blocked_training"),
                F.when(
                    mod(12) == 2,
                    F.array(F.struct(F.lit("Googlebot").alias("bot"), F.array(F.lit("/blog/")).alias("paths"))),
                ).otherwise(F.array().cast("array<struct<bot:string,paths:array<string>>>")).alias("partial_blocks"),
                F.lit("note").alias("note"),
            ),
        ).alias("robots"),
    )


SIGNAL_POINTS = """
raw AS (
  SELECT p_partkey, p_partkey % 11 = 0 AS render,
    CASE WHEN p_partkey % 4 = 0 THEN 11 WHEN p_partkey % 12 = 1 THEN 2 WHEN p_partkey % 12 = 2 THEN 9 ELSE 15 END AS crawl,
    least(10, (p_partkey % 2 = 0)::INT * 7 + (p_partkey % 3 = 0)::INT * 3 + (p_partkey % 5 = 0)::INT * 2
      + (p_partkey % 7 = 0)::INT * 2) AS schema_,
    CASE p_partkey % 3 WHEN 2 THEN 5 WHEN 1 THEN 3 ELSE 0 END AS price,
    CASE WHEN (p_partkey % 10) / 100.0 >= 0.06 THEN 6 WHEN (p_partkey % 10) / 100.0 >= 0.02 THEN 3 ELSE 0 END
      + CASE WHEN p_partkey % 60 <= 25 THEN 4 WHEN p_partkey % 60 <= 50 THEN 2 ELSE 0 END AS extract_,
    (p_partkey % 4 > 0)::INT * 4 + (p_partkey % 9 > 3)::INT * 4 + (p_partkey % 2 = 0)::INT * 2 AS local_,
    CASE WHEN p_partkey % 6 >= 4 THEN 10 WHEN p_partkey % 6 >= 1 THEN 6 ELSE 0 END + (p_partkey % 8 >= 1)::INT * 5 AS eeat,
    CASE WHEN p_partkey % 4 >= 2 THEN 10 WHEN p_partkey % 4 = 1 THEN 6 ELSE 0 END AS fresh,
    (p_partkey % 2 >= 1)::INT * 2 + (p_partkey % 5 >= 3)::INT * 2 + (p_partkey % 3 >= 1)::INT * 3
      + (p_partkey % 7 >= 1)::INT * 2 + (p_partkey % 6 >= 1)::INT * 1 AS answer,
    (p_partkey % 13 > 6)::INT * 7 + CASE p_partkey % 3 WHEN 2 THEN 4 WHEN 1 THEN 2 ELSE 0 END
      + (p_partkey % 17 > 8)::INT * 4 AS citable
  FROM part),
points AS (SELECT * REPLACE (CASE WHEN render THEN least(2, extract_) ELSE extract_ END AS extract_) FROM raw)
"""


# --- history from orders ----------------------------------------------------------------------

def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("site"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("record_id"),
        (F.col("o_orderkey") % 101).alias("score"),
    )


HISTORY = """
history AS (
  SELECT o_custkey AS site, o_orderdate AS ts, o_orderkey AS record_id, o_orderkey % 101 AS score FROM orders)
"""


# --- listings from customer and supplier ------------------------------------------------------

def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are listings of their nation, ranked by key; names carry institution suffixes."""
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey", PER_TASK)
    k = F.col("c_custkey")
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("치과의원", "치과", "의원", "")]), (k % 4 + 1).cast("int"))
    return c.select(
        F.col("c_nationkey").cast("bigint").alias("query"), k.alias("rank"), k.alias("place_id"),
        F.concat(F.lit("B"), (k % 50).cast("string"), suffix).alias("name"),
        F.when(k % 3 > 0, F.concat(F.lit("02-"), F.lpad((k % 97).cast("string"), 3, "0"), F.lit("-"), F.lpad((k % 89).cast("string"), 4, "0"))).alias("phone"),
        F.floor(F.abs("c_acctbal")).cast("bigint").alias("visitor_reviews"),
        (k % 700).alias("blog_reviews"), (k % 4).alias("booking_reviews"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dealt(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", PER_TASK)
    k = F.col("s_suppkey")
    return s.select(
        F.col("s_nationkey").cast("bigint").alias("query"), k.alias("site"),
        F.concat(F.when(k % 2 == 0, F.lit("동네 B")).otherwise(F.lit("B")), (k % 60).cast("string"), F.lit(" 치과")).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("02 "), F.lpad((k % 97).cast("string"), 3, "0"), F.lpad((k % 89).cast("string"), 4, "0")))
        .when(k % 4 == 1, F.concat(F.lit("031-"), F.lpad((k % 97).cast("string"), 3, "0"), F.lit("-"), F.lpad((k % 89).cast("string"), 4, "0")))
        .alias("phone"),
    )


PLACES = """
places AS (
  SELECT CAST(c_nationkey AS BIGINT) AS query, c_custkey AS rank, c_custkey AS place_id,
         'B' || (c_custkey % 50) || CASE c_custkey % 4 WHEN 0 THEN '치과의원' WHEN 1 THEN '치과' WHEN 2 THEN '의원' ELSE '' END AS name,
         CASE WHEN c_custkey % 3 > 0 THEN '02-' || lpad(CAST(c_custkey % 97 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 89 AS VARCHAR), 4, '0') END AS phone,
         CAST(floor(abs(c_acctbal)) AS BIGINT) AS visitor_reviews, c_custkey % 700 AS blog_reviews, c_custkey % 4 AS booking_reviews
  FROM customer),
sites AS (
  SELECT CAST(s_nationkey AS BIGINT) AS query, s_suppkey AS site,
         CASE WHEN s_suppkey % 2 = 0 THEN '동네 B' ELSE 'B' END || (s_suppkey % 60) || ' 치과' AS name,
         CASE s_suppkey % 4
           WHEN 0 THEN '02 ' || lpad(CAST(s_suppkey % 97 AS VARCHAR), 3, '0') || lpad(CAST(s_suppkey % 89 AS VARCHAR), 4, '0')
           WHEN 1 THEN '031-' || lpad(CAST(s_suppkey % 97 AS VARCHAR), 3, '0') || '-' || lpad(CAST(s_suppkey % 89 AS VARCHAR), 4, '0') END AS phone
  FROM supplier),
listing AS (
  SELECT *, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS digits,
    CASE WHEN length(regexp_replace(lower(replace(name, ' ', '')), '(치과의원|치과병원|교정과|한의원|클리닉|덴탈|치과|병원|의원)+$', '')) >= 2
         THEN regexp_replace(lower(replace(name, ' ', '')), '(치과의원|치과병원|교정과|한의원|클리닉|덴탈|치과|병원|의원)+$', '')
         ELSE lower(replace(name, ' ', '')) END AS core FROM places),
wanted AS (
  SELECT *, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS digits,
    regexp_replace(lower(replace(name, ' ', '')), '(치과의원|치과병원|교정과|한의원|클리닉|덴탈|치과|병원|의원)+$', '') AS core FROM sites),
pairs AS (
  SELECT w.query, w.site, l.rank, l.place_id, l.name AS place_name,
    CASE WHEN length(w.digits) >= 7 AND l.digits = w.digits THEN 1
         WHEN length(w.digits) >= 7 AND length(l.digits) >= 7 AND right(l.digits, 7) = right(w.digits, 7) THEN 2
         WHEN length(w.core) >= 2 AND length(l.core) >= 2 AND l.core = w.core THEN 3
         WHEN length(w.core) >= 2 AND length(l.core) >= 2 AND (contains(l.core, w.core) OR contains(w.core, l.core)) THEN 4 END AS tier
  FROM wanted w JOIN listing l ON w.query = l.query),
matched AS (
  SELECT query, site, tier, rank AS target_rank, place_id, place_name FROM pairs WHERE tier IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query, site ORDER BY tier, rank) = 1)
"""
