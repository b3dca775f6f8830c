"""What may leave the house: public and private views, leak scan, masking, copy checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.stats import wilson
from ..functions.text import col, text_or_empty
from ..functions.urls import url_path

PUBLIC_ENGINE = [
    "engine", "valid_runs", "cited_runs", "named_runs", "inconclusive_runs", "errored_runs", "hit_rate",
    "cited", "exposed", "measured", "unmeasurable",
]
PUBLIC_DISTRIBUTION = [
    "prompts_scored", "always_cited", "never_cited", "sometimes_cited", "spread", "distribution_note",
]
PUBLIC_PROMPT = ["engine", "prompt", "valid", "cited", "rate", "inconclusive", "errored"]


def public_view(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H1: named columns only, never a `drop`; the interval is gated again."""
    interval = F.when(
        F.col("measured") & (F.col("cited_runs") > 0) & (F.col("valid_runs") >= 2),
        wilson("cited_runs", "valid_runs"),
    )
    shape = [c for c in PUBLIC_DISTRIBUTION if c in panel.columns]
    return panel.select(
        *keys, *PUBLIC_ENGINE, *shape, interval["low"].alias("ci_low"), interval["high"].alias("ci_high"),
        F.lit("public").alias("view"),
    )


def public_prompts(prompts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H1: the questions we asked are ours, so they may be shown with their counts."""
    return prompts.select(*keys, *PUBLIC_PROMPT)


def cited_path_match(evidence: DataFrame, inputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact, domain or none per input page. `inputs`: keys, input_url.

    Only a flag per distinct input path is aggregated; cited paths are never collected.
    """
    wanted = inputs.withColumn("input_path", url_path("input_url"))
    seen = evidence.where(F.col("kind") == "matched").select(
        *keys, F.explode("matched_urls").alias("url")
    ).select(*keys, url_path("url").alias("path"))
    paths = seen.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("_hits"))
    sites = paths.groupBy(*keys).agg(
        F.count("path").alias("cited_paths"), F.lit(True).alias("_any")
    )
    exact = paths.select(*keys, F.col("path").alias("input_path"), F.lit(True).alias("_exact"))
    return (
        wanted.join(sites, list(keys), "left")
        .join(exact, [*keys, "input_path"], "left")
        .select(
            *inputs.columns, "input_path", F.coalesce("cited_paths", F.lit(0)).alias("cited_paths"),
            F.when(
                F.col("input_path").isNotNull(),
                F.when(F.col("_exact"), "exact").when(F.col("_any"), "domain").otherwise("none"),
            ).alias("match"),
        )
    )


def private_view(panel: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """H2: the whole panel plus the compare candidates (at most 15 per engine)."""
    listed = candidates.groupBy(*keys, "engine").agg(
        F.array_sort(F.collect_list(F.struct("domain_ord", "domain"))).alias("_c")
    )
    return (
        panel.join(listed, [*keys, "engine"], "left")
        .withColumn(
            "compare_candidates",
            F.coalesce(F.transform("_c", lambda c: c["domain"]), F.array().cast("array<string>")),
        )
        .drop("_c")
        .withColumn("view", F.lit("private"))
    )


def leak_scan(df: DataFrame, own_domain: str) -> DataFrame:
    """H3: rows whose serialized form holds an http(s) URL that is not the site's own."""
    payload = F.to_json(F.struct("*"))
    urls = F.regexp_extract_all(payload, F.lit(r'(https?://[^"\s]+)'), F.lit(1))
    foreign = F.filter(urls, lambda u: ~u.contains(F.col(own_domain)))
    return df.withColumn("leaked_urls", foreign).where(F.size("leaked_urls") > 0)


def mask_email(email: Column | str) -> Column:
    """H4: first character, three stars, domain."""
    return F.regexp_replace(text_or_empty(email), r"^(.).*(@.*)$", "$1***$2")


def hash_ip(ip: Column | str) -> Column:
    """H5: 16 hex digits that stay equal for equal addresses."""
    raw = F.when(text_or_empty(ip) == "", "unknown").otherwise(col(ip))
    return F.substring(F.sha2(raw, 256), 1, 16)


def forbidden_copy_scan(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """H6: texts with banned superlatives, one row per column and hit."""
    return (
        df.unpivot(list(keys), list(columns), "field", "copy")
        .where(F.col("copy").rlike(K.FORBIDDEN_COPY))
    )
