"""First-party funnel: AI crawlers, AI referrals, and both around the citation panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import col, text_or_empty


def keep_ai_sessions(sessions: DataFrame, medium: str = "medium", token: str = K.AI_MEDIUM) -> DataFrame:
    """The stable medium token, not the translated channel label."""
    return sessions.where(F.col(medium) == token)


def ai_sessions_by_platform(sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """L1: sessions, users and key events per source/medium and in total, one pass (rollup).

    The total row has `is_total`. Users are summed as reported, the same as in the export's total.
    """
    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name)), F.lit(0)).alias(name)

    named = sessions.withColumn("source_medium", F.coalesce(F.col("source_medium"), F.lit("(unknown)")))
    sets = [[*keys, "source_medium"], list(keys)]
    rolled = named.groupingSets(sets, *[*keys, "source_medium"]).agg(
        total("sessions"), total("users"), total("key_events"),
        (F.grouping("source_medium") == 1).alias("is_total"),
    )
    return rolled


def bot_by_detection(ids: Column | str) -> Column:
    """L2: bot of the first known detection id, else `id:` and the ids as given."""
    known = F.create_map(*[F.lit(x) for bot, numbers in K.BOT_DETECTION_IDS for n in numbers for x in (n, bot)])
    given = F.coalesce(col(ids).cast("array<bigint>"), F.array().cast("array<bigint>"))
    names = F.filter(F.transform(given, lambda i: known[i.cast("int")]), lambda b: b.isNotNull())
    rest = F.concat(F.lit("id:"), F.array_join(F.transform(given, lambda i: i.cast("string")), ","))
    return F.coalesce(F.get(names, F.lit(0)), rest)


def bot_by_agent(user_agent: Column | str, bots: Sequence[str] = K.UA_BOTS) -> Column:
    """L3: the first known token, in list order and case-sensitive, else the first 40 characters."""
    agent = F.when(text_or_empty(user_agent) == "", "(ua)").otherwise(col(user_agent))
    hits = [F.when(agent.contains(b), F.lit(b)) for b in bots]
    return F.coalesce(*hits, F.substring(agent, 1, 40))


def bot_hits_by_bot(hits: DataFrame, keys: Sequence[str] = (), mode: str = "precise") -> DataFrame:
    """L2, L3: hits per bot, counted by detection id (precise) or user agent (ua)."""
    bot = bot_by_detection("detection_ids") if mode == "precise" else bot_by_agent("user_agent")
    count = F.coalesce(F.sum("count"), F.lit(0)).cast("bigint")
    return hits.withColumn("bot", bot).groupBy(*keys, "bot").agg(count.alias("hits"))


def search_bots_crawling(by_bot: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """L4: total, and did any known bot come at all?"""
    return by_bot.groupBy(*keys).agg(
        F.sum("hits").alias("total"), F.bool_or(F.col("bot").isin(K.UA_BOTS)).alias("search_bots_crawling")
    )


def funnel(
    by_bot: DataFrame, panel: DataFrame, sessions: DataFrame, keys: Sequence[str],
    links: Sequence[tuple[str, str, str]] = K.FUNNEL_LINKS, bots: Sequence[tuple[str, str, str]] = K.BOTS,
) -> DataFrame:
    """Crawl -> cited -> sessions per engine. Each side is summed before the outer join."""
    operator_of = {token: operator for token, operator, _ in bots}
    engine_of_bot = {t: e for e, o, _ in links for t, op in operator_of.items() if op == o}
    bot_engine = F.create_map(*[F.lit(x) for pair in engine_of_bot.items() for x in pair])
    crawled = by_bot.withColumn("engine", bot_engine[F.col("bot")]).where(F.col("engine").isNotNull())
    crawled = crawled.groupBy(*keys, "engine").agg(F.sum("hits").alias("crawl_hits"))

    host_engine = F.coalesce(
        *[F.when(F.col("source_medium").startswith(host), F.lit(engine)) for engine, _, host in links]
    )
    came = sessions.withColumn("engine", host_engine).where(F.col("engine").isNotNull())
    came = came.groupBy(*keys, "engine").agg(
        F.sum("sessions").alias("sessions"), F.sum("key_events").alias("key_events")
    )
    cited = panel.groupBy(*keys, "engine").agg(
        F.sum("valid_runs").alias("valid_runs"), F.sum("cited_runs").alias("cited_runs")
    )
    on = [*keys, "engine"]
    return crawled.join(cited, on, "full_outer").join(came, on, "full_outer").select(
        *on, "crawl_hits", "valid_runs", "cited_runs",
        F.round(F.when(F.col("valid_runs") > 0, F.col("cited_runs") / F.col("valid_runs")), 2).alias("hit_rate"),
        "sessions", "key_events",
    )
