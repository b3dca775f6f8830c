"""The citation panel: outcomes -> prompts -> engines.

Outcomes shuffle once, already summed per map task on (keys, engine, prompt). Engine rows and
distributions come from those few prompt rows, so a site with a third of all runs costs its
partial sums only. `keys` are the panel columns, for example site, region, procedure.

Outcome columns read: engine, prompt, run_ord (order of the runs), status, cited, named, position,
matched_urls, cited_domains, answer, error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ordered import top_k
from ..functions.stats import ratio, wilson
from ..functions.text import text_or_empty
from ..functions.urls import drop_platforms


def _count(test: Column) -> Column:
    return F.count_if(test)


def prompt_counts(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one aggregation over runs: everything the panel needs, per prompt."""
    status = F.col("status")
    valid = status == "valid"
    position = F.col("position") if "position" in outcomes.columns else F.lit(None).cast("string")
    order = F.min("run_ord") if "run_ord" in outcomes.columns else F.min("prompt")
    return outcomes.groupBy(*keys, "engine", "prompt").agg(
        F.count(F.lit(1)).alias("attempts"),
        _count(status == "error").alias("errored"),
        _count(status == "inconclusive").alias("inconclusive"),
        _count(valid).alias("valid"),
        _count(valid & F.col("cited")).alias("cited"),
        _count(valid & F.col("named")).alias("named"),
        _count((status != "error") & F.col("named")).alias("named_any"),
        *[
            _count(valid & F.col("cited") & (position == p)).alias(f"pos_{p}")
            for p in ("top", "mid", "tail")
        ],
        order.alias("first_ord"),
    )


def panel_by_prompt(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and rate per prompt. No valid run means no rate, not a rate of 0."""
    rows = prompt_counts(outcomes, keys)
    return rows.select(
        *keys, "engine", "prompt", "valid", "cited", "named", "errored", "inconclusive",
        F.round(ratio("cited", "valid"), 2).alias("rate"), "first_ord",
    )


def _engine_row(totals: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    interval = F.when(
        (F.col("cited_runs") > 0) & (F.col("valid_runs") >= 2), wilson("cited_runs", "valid_runs")
    )
    measured = F.col("valid_runs") > 0
    return totals.select(
        *keys, "engine", "attempts", "valid_runs", "cited_runs", "named_runs", "errored_runs",
        "inconclusive_runs", "pos_top", "pos_mid", "pos_tail",
        F.coalesce(F.round(ratio("cited_runs", "valid_runs"), 2), F.lit(0.0)).alias("hit_rate"),
        (F.col("cited_runs") > 0).alias("cited"),
        ((F.col("cited_runs") > 0) | (F.col("named_runs") > 0)).alias("exposed"),
        interval["low"].alias("ci_low"), interval["high"].alias("ci_high"),
        measured.alias("measured"),
        unmeasurable_reason(measured, F.col("errored_runs"), F.col("inconclusive_runs")).alias("unmeasurable"),
        *extra,
    )


def unmeasurable_reason(measured: Column, errored: Column, inconclusive: Column) -> Column:
    """Why there is no valid run, NULL if there is one."""
    return F.when(
        ~measured,
        F.when(errored > 0, "engine-error").when(inconclusive > 0, "no-search").otherwise("no-key"),
    )


def _totals() -> list[Column]:
    return [
        F.sum("attempts").alias("attempts"), F.sum("valid").alias("valid_runs"),
        F.sum("cited").alias("cited_runs"), F.sum("named_any").alias("named_runs"),
        F.sum("errored").alias("errored_runs"), F.sum("inconclusive").alias("inconclusive_runs"),
        *[F.sum(f"pos_{p}").alias(f"pos_{p}") for p in ("top", "mid", "tail")],
    ]


def panel_by_engine(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The honest rate per engine. Errors and runs without citations leave the base."""
    rows = prompt_counts(outcomes, keys)
    return _engine_row(rows.groupBy(*keys, "engine").agg(*_totals()), keys)


def _distribution(scored: Column) -> list[Column]:
    return [
        _count(scored).alias("prompts_scored"),
        _count(scored & (F.col("cited") == F.col("valid"))).alias("always_cited"),
        _count(scored & (F.col("cited") == 0)).alias("never_cited"),
    ]


def _distribution_row(repeats: int) -> list[Column]:
    scored = F.col("prompts_scored")
    some = scored - F.col("always_cited") - F.col("never_cited")
    gap = F.abs(F.col("always_cited") - F.col("never_cited"))
    return [
        "prompts_scored", "always_cited", "never_cited", some.alias("sometimes_cited"),
        F.round(1 - ratio(gap, scored), 2).alias("spread"),
        F.when((scored > 0) & F.lit(repeats < 2), K.SINGLE_REPEAT_NOTE).alias("distribution_note"),
    ]


def prompt_distribution(prompts: DataFrame, keys: Sequence[str], repeats: int = K.MAX_REPEATS) -> DataFrame:
    """Does the result depend on the question? Counted exactly, not on rounded rates.

    `prompts` is the output of `panel_by_prompt` or `prompt_counts`. Engines without a scored
    prompt have no distribution.
    """
    counted = prompts.groupBy(*keys, "engine").agg(*_distribution(F.col("valid") > 0))
    return counted.where(F.col("prompts_scored") > 0).select(*keys, "engine", *_distribution_row(repeats))


def citation_panel(outcomes: DataFrame, keys: Sequence[str], repeats: int = K.MAX_REPEATS) -> DataFrame:
    """G8 to G12 in one pass: engine rows with their distribution."""
    return citation_panel_of(prompt_counts(outcomes, keys), keys, repeats)


def citation_panel_of(prompts: DataFrame, keys: Sequence[str], repeats: int = K.MAX_REPEATS) -> DataFrame:
    """The same from the counts per prompt."""
    totals = prompts.groupBy(*keys, "engine").agg(*_totals(), *_distribution(F.col("valid") > 0))
    return _engine_row(totals, keys, _distribution_row(repeats))


def cited_domain_counts(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Domains cited in valid runs: first appearance and number of runs. Sums before the shuffle."""
    seen = outcomes.where(F.col("status") == "valid").select(
        *keys, "engine", "run_ord", F.posexplode("cited_domains").alias("pos", "domain")
    )
    return seen.groupBy(*keys, "engine", "domain").agg(
        F.min(F.struct("run_ord", "pos")).alias("first_seen"), F.count(F.lit(1)).alias("runs")
    )


def cited_domains(outcomes: DataFrame, keys: Sequence[str], k: int = K.MAX_CITED_DOMAINS) -> DataFrame:
    """The first k domains per engine. Private data."""
    counted = cited_domain_counts(outcomes, keys)
    return top_k(counted, [*keys, "engine"], [F.col("first_seen").asc()], k, "domain_ord").select(
        *keys, "engine", "domain_ord", "domain", "runs"
    )


def compare_candidates(outcomes: DataFrame, keys: Sequence[str], k: int = K.MAX_CITED_DOMAINS) -> DataFrame:
    """Of these, the ones with a site of their own."""
    return drop_platforms(cited_domains(outcomes, keys, k), "domain")


def share_of_citations(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of valid runs that cite a domain, ranked.

    The rank comes from the histogram of run counts (few distinct values per group), so the domains
    of a group are never sorted in one task.
    """
    group = [*keys, "engine"]
    counted = cited_domain_counts(outcomes, keys)
    base = outcomes.where(F.col("status") == "valid").groupBy(*group).agg(F.count(F.lit(1)).alias("valid_runs"))
    above = Window.partitionBy(*group).orderBy(F.col("runs").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counted.groupBy(*group, "runs").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "runs", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).alias("share_rank")
    )
    return (
        counted.join(ranks, [*group, "runs"])
        .join(base, group)
        .select(*group, "domain", "runs", F.round(ratio("runs", "valid_runs"), 4).alias("share"), "share_rank")
    )


def sample_answers(
    outcomes: DataFrame, keys: Sequence[str], k: int = K.MAX_SAMPLE_ANSWERS, chars: int = K.SAMPLE_ANSWER_CHARS
) -> DataFrame:
    """The first answer per prompt, for the first k prompts that have one. Private data."""
    said = outcomes.where((F.col("status") != "error") & (text_or_empty("answer") != "")).select(
        *keys, "engine", "prompt", "run_ord", "cited", F.substring("answer", 1, chars).alias("answer")
    )
    first = said.groupBy(*keys, "engine", "prompt").agg(
        F.min("run_ord").alias("first_ord"), F.min_by(F.struct("answer", "cited"), "run_ord").alias("_a")
    )
    best = top_k(first, [*keys, "engine"], [F.col("first_ord").asc()], k, "answer_ord")
    return best.select(*keys, "engine", "answer_ord", "prompt", F.col("_a.answer").alias("answer"), F.col("_a.cited").alias("cited"))


def panel_evidence(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What was seen in a run: an error, nothing cited, or the site's own URLs. Private data."""
    status = F.col("status")
    kind = F.when(status == "error", "error").when(status == "inconclusive", "inconclusive").when(
        F.col("cited"), "matched"
    )
    optional = [c for c in ("run_ord", "ts", "error", "matched_urls") if c in outcomes.columns]
    return outcomes.select(*keys, "engine", "prompt", *optional, kind.alias("kind")).where(
        F.col("kind").isNotNull()
    )


def hit_map(
    panel: DataFrame, rows: Sequence[str], column: str = "engine", engines: Sequence[str] = tuple(K.AUTO_ENGINES),
    failures: DataFrame | None = None,
) -> DataFrame:
    """One row per region, one column per engine with cited/valid, NULL if unmeasured.

    `failures` (row columns, error) keeps regions whose measurement failed.
    """
    cell = F.when(
        F.col("measured"),
        F.concat_ws("/", F.col("cited_runs").cast("string"), F.col("valid_runs").cast("string")),
    )
    table = panel.withColumn("_cell", cell).groupBy(*rows).pivot(column, list(engines)).agg(F.first("_cell"))
    if failures is None:
        return table
    return table.join(failures.select(*rows, "error"), list(rows), "full_outer")
