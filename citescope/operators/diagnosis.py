"""Structure x panel -> findings.

The panel shrinks to one row per site first, then meets the structure in one full outer join.
All findings of a site are built as one array in that row and exploded, so the join runs once and
not once per rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ordered import top_k

_COUNTS = "array<struct<engine:string,scored:bigint,always:bigint,never:bigint,prompts:string>>"


def panel_summary(panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per panel: how many engines were measured, cited, named only, and why not."""
    measured = F.col("measured")
    named_only = measured & (F.col("cited_runs") == 0) & (F.col("named_runs") > 0)
    return panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("engines"),
        F.count_if(measured).alias("measured_engines"),
        F.count_if(measured & (F.col("cited_runs") > 0)).alias("cited_engines"),
        F.array_join(F.array_sort(F.collect_set(F.when(named_only, F.col("engine")))), "·").alias("named_only"),
        F.coalesce(F.bool_or(F.when(measured, F.col("exposed"))), F.lit(False)).alias("any_exposed"),
        F.bool_and(F.coalesce(F.col("unmeasurable") == "no-search", F.lit(False))).alias("all_no_search"),
        F.bool_or(F.coalesce(F.col("unmeasurable") == "engine-error", F.lit(False))).alias("any_error"),
        F.coalesce(F.sum(F.when(measured, F.col("valid_runs"))), F.lit(0)).alias("valid_runs"),
        F.coalesce(F.sum(F.when(measured, F.col("cited_runs"))), F.lit(0)).alias("cited_runs"),
    )


def prompt_gaps(prompts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """I5 input: engines whose prompts are split between always and never, with three never prompts.

    `prompts` is the output of `panel_by_prompt`. One row per panel with at most one entry per engine.
    """
    scored = prompts.where(F.col("valid") > 0)
    group = [*keys, "engine"]
    counts = scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(F.col("cited") == F.col("valid")).alias("always"),
        F.count_if(F.col("cited") == 0).alias("never"),
    ).where((F.col("scored") >= 2) & (F.col("always") > 0) & (F.col("never") > 0))
    order = [F.col("first_ord").asc(), F.col("prompt").asc()]
    first = top_k(scored.where(F.col("cited") == 0), group, order, 3, "_no")
    quoted = first.groupBy(*group).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_no", "prompt"))),
                lambda x: F.concat(F.lit('"'), x["prompt"], F.lit('"')),
            ),
            ", ",
        ).alias("prompts")
    )
    return counts.join(quoted, group).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("engine", "scored", "always", "never", "prompts"))).alias("gaps")
    )


def _finding(code: str, when: Column, detail: Column, title: Column | None = None, check: Column | None = None) -> Column:
    severity, blocking, text, how, action = K.FINDINGS[code]
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(blocking).alias("blocking"),
            (title if title is not None else F.lit(text)).alias("title"),
            detail.alias("detail"),
            (check if check is not None else F.lit(how)).alias("check"),
            F.lit(action).alias("action"),
        ),
    )


def _item(field: str, key: str) -> Column:
    return F.get(F.filter(F.col("items"), lambda x: x["key"] == key), F.lit(0))[field]


_PANEL_COLUMNS = {
    "engines": "bigint", "measured_engines": "bigint", "cited_engines": "bigint", "named_only": "string",
    "any_exposed": "boolean", "all_no_search": "boolean", "any_error": "boolean", "valid_runs": "bigint",
    "cited_runs": "bigint", "gaps": _COUNTS,
}


def _no_panel(structure: DataFrame) -> DataFrame:
    return structure.withColumns({n: F.lit(None).cast(kind) for n, kind in _PANEL_COLUMNS.items()})


def structure_findings(rows: DataFrame) -> DataFrame:
    """Diagnosis from structure alone, in the row: adds findings and headline, keeps the rest."""
    found = _no_panel(rows).withColumn("findings", finding_array())
    return found.withColumn("headline", headline(F.col("findings"))).drop(*_PANEL_COLUMNS)


def site_state(
    structure: DataFrame, panel: DataFrame | None, keys: Sequence[str], prompts: DataFrame | None = None,
    site: str = "site",
) -> DataFrame:
    """Structure (one row per site: score, band, needs_render, items) full outer joined to the panel."""
    shape = structure.select(site, "score", "band", "needs_render", "items")
    if panel is None:
        return _no_panel(shape)
    summary = panel_summary(panel, keys)
    if prompts is None:
        summary = summary.withColumn("gaps", F.lit(None).cast(_COUNTS))
    else:
        summary = summary.join(prompt_gaps(prompts, keys), list(keys), "left")
    return summary.join(shape, site, "full_outer")


def finding_array() -> Column:
    """I1 to I9 for a row of `site_state`, sorted by severity, in rule order inside a severity."""
    has_panel = F.col("engines").isNotNull()
    unmeasured = has_panel & (F.col("measured_engines") == 0)
    why = (
        F.when(F.col("engines") == 0, "no-key")
        .when(F.col("all_no_search"), "no-search")
        .when(F.col("any_error"), "engine-error")
        .otherwise("unknown")
    )
    details = K.NOT_MEASURED_DETAIL
    why_detail = F.when(why == "no-search", details["no-search"]).when(
        why == "engine-error", details["engine-error"]
    ).otherwise(details["other"])

    crawl = F.coalesce(_item("status", "crawl") == "fail", F.lit(False))
    render = F.coalesce(F.col("needs_render"), F.lit(False)) | F.coalesce(
        _item("status", "extract") == "fail", F.lit(False)
    )
    blocked = crawl | render
    open_panel = has_panel & ~blocked
    score = F.coalesce(F.col("score"), F.lit(0)).cast("int")
    gaps = F.coalesce(
        F.transform(
            F.when(open_panel, F.col("gaps")),
            lambda g: _finding(
                "prompt-gap", F.lit(True),
                F.format_string(K.PROMPT_GAP_DETAIL, g["scored"], g["always"], g["never"]),
                F.format_string(K.FINDINGS["prompt-gap"][2], g["engine"]),
                F.format_string(K.FINDINGS["prompt-gap"][3], g["prompts"]),
            ),
        ),
        F.array(),
    )
    singles = [
        _finding("crawl-blocked", crawl, _item("note", "crawl")),
        _finding("js-rendered", render, F.coalesce(_item("note", "extract"), F.lit(K.RENDER_DETAIL))),
        _finding(
            "named-not-linked",
            open_panel & (F.col("named_only") != "") & (F.col("cited_engines") == 0),
            F.format_string(K.NAMED_DETAIL, F.col("named_only")),
        ),
    ]
    later = [
        _finding(
            "structure-ok-not-exposed",
            open_panel & (F.col("measured_engines") > 0) & ~F.col("any_exposed") & (score >= K.STRUCTURE_OK_SCORE),
            F.format_string(K.STRUCTURE_OK_DETAIL, score),
        ),
        _finding("no-citable-evidence", _item("points", "citable") == 0, _item("note", "citable")),
        _finding("no-price", _item("points", "price") == 0, _item("note", "price")),
        _finding("no-date", _item("points", "fresh") == 0, _item("note", "fresh")),
    ]
    usual = F.array_compact(F.concat(F.array(*singles), gaps, F.array(*later)))
    def of_severity(name: str) -> Column:
        return F.filter(usual, lambda f: f["severity"] == name)

    by_severity = F.concat(*[of_severity(name) for name in K.SEVERITY_ORDER])
    stopped = F.array(_finding("not-measured", F.lit(True), why_detail))
    return F.when(unmeasured, stopped).otherwise(by_severity)


def headline(findings: Column) -> Column:
    """The sentence on top of the report."""
    has_panel = F.col("engines").isNotNull()
    exposed = F.col("any_exposed")
    return (
        F.when(has_panel & (F.col("measured_engines") == 0), K.HEADLINES["unmeasured"])
        .when(F.exists(findings, lambda f: f["blocking"]), K.HEADLINES["blocked"])
        .when(has_panel & exposed, K.HEADLINES["exposed"])
        .when(has_panel & ~exposed, K.HEADLINES["absent"])
        .otherwise(K.HEADLINES["structure"])
    )


def diagnose(state: DataFrame) -> DataFrame:
    """Adds findings (ordered array), headline, measured and exposed."""
    found = state.withColumn("findings", finding_array())
    has_panel = F.col("engines").isNotNull()
    measured = F.col("measured_engines") > 0
    return found.select(
        *[c for c in state.columns if c not in ("items", "gaps")],
        "findings", headline(F.col("findings")).alias("headline"),
        F.when(has_panel, measured).alias("measured"),
        F.when(has_panel & measured, F.col("any_exposed")).alias("exposed"),
    )


def findings(diagnosed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The long form: one row per finding with its position."""
    rows = diagnosed.select(*keys, F.posexplode("findings").alias("_pos", "_f"))
    return rows.select(*keys, (F.col("_pos") + 1).alias("finding_no"), "_f.*")


def diagnose_by_region(
    structure: DataFrame, panel: DataFrame, regions: DataFrame, keys: Sequence[str],
    prompts: DataFrame | None = None, site: str = "site",
) -> DataFrame:
    """One structure row per site against every region panel; a failed region stays with NULLs.

    `regions` lists the requested panels (keys) and an `error` column, NULL where measured.
    """
    measured = diagnose(site_state(structure, panel, keys, prompts, site))
    return regions.join(measured, list(keys), "left")
