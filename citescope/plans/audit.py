"""The page chain: crawl snapshot -> signals -> scores -> diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.urls import embeddable, registrable_domain, url_problem
from ..operators import diagnosis, scoring, signals
from ..operators.robots import robots_summary
from ..sources.readers import with_host, with_robots


def page_profiles(pages: DataFrame, robots: DataFrame | None = None, keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Signals of every page with the robots summary of its host."""
    extra = [c for c in ("headers", "status", "final_url") if c in pages.columns]
    wide = signals.page_signals(pages, keep=[*keys, *extra])
    hosted = with_host(wide, "final_url" if "final_url" in extra else "url")
    if robots is None:
        return hosted
    return with_robots(hosted, robots_summary(robots))


def audit(pages: DataFrame, robots: DataFrame | None = None, keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """F16: one row per page: score, band, gates, axes, fixes, structure findings, signals.

    The page text is read once; html is gone after the shred pass. No shuffle except the join of
    robots to hosts.
    """
    rows = structure_rows(pages, robots, keys)
    return diagnosis.structure_findings(rows).withColumn("domain", registrable_domain("url"))


def structure_rows(pages: DataFrame, robots: DataFrame | None = None, keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """What diagnosis and comparison need of a page: scores with items, plus the compare profile."""
    profiles = page_profiles(pages, robots, keys)
    carry = [c for c in profiles.columns if c not in keys]
    return scoring.page_scores(profiles, [*keys, *carry])


def batch_audit(
    pages: DataFrame, robots: DataFrame | None = None, history: DataFrame | None = None,
    now: Column | None = None, keys: Sequence[str] = ("page_id", "url"),
) -> DataFrame:
    """M5: score many sites; a URL that may not be measured stays as a row with its error."""
    checked = pages.withColumn("error", url_problem("url"))
    rejected = checked.where(F.col("error").isNotNull()).select(
        *keys, registrable_domain("url").alias("domain"), "error"
    )
    scored = scoring.page_scores(page_profiles(checked.where(F.col("error").isNull()), robots, keys), keys)
    rows = scored.select(
        *keys, registrable_domain("url").alias("domain"), "score", "band", F.lit(None).cast("string").alias("error")
    )
    if history is not None:
        stamp = now if now is not None else F.current_timestamp()
        earlier = history.groupBy("domain").agg(F.max_by(F.struct("score", "band"), "ts").alias("_h"))
        rows = rows.join(earlier, "domain", "left").select(
            *rows.columns, F.col("_h.score").alias("prev_score"), F.col("_h.band").alias("prev_band"),
            stamp.alias("measured_at"),
        ).withColumn("delta", F.col("score") - F.col("prev_score"))
    return rows.unionByName(rejected, allowMissingColumns=True)


def audit_full(
    pages: DataFrame, robots: DataFrame | None = None, llms: DataFrame | None = None, keys: Sequence[str] = ("page_id", "url")
) -> DataFrame:
    """F16 with everything that is known about a page: `audit` plus `readiness` (forms), `teardown`, `has_llms_txt`
    (`llms`: host, status), `embeddable` (if pages carry `headers`) and the versions the figures stand under.

    The page text is read once and only the joins of robots and llms.txt to hosts shuffle, one row per host each.
    """
    wide = page_profiles(pages.withColumn("teardown", signals.teardown("html")), robots, [*keys, "teardown"])
    packed = wide.select(F.struct(*wide.columns).alias("_wide"), "forms", "needs_render")
    ready = scoring.agent_readiness(packed, ["_wide"])
    rows = ready.select("_wide.*", F.struct(*[c for c in ready.columns if c != "_wide"]).alias("readiness"))
    if "headers" in rows.columns:
        rows = rows.withColumn("embeddable", embeddable("headers"))
    if llms is not None:
        rows = signals.with_llms_txt(rows, llms)
    carry = [c for c in rows.columns if c not in keys]
    scored = diagnosis.structure_findings(scoring.page_scores(rows, [*keys, *carry]))
    return scored.withColumns({
        "domain": registrable_domain("url"), "methodology_version": F.lit(K.METHODOLOGY_VERSION),
        "disclaimer": F.lit(K.SCORE_DISCLAIMER), "form_thresholds_version": F.lit(K.FORM_THRESHOLDS_VERSION),
    })
