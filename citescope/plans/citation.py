"""The response chain: raw responses -> outcomes -> panel -> diagnosis -> public and private views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.storage import run_folder
from ..operators import diagnosis, panel, views
from ..operators.responses import parse_responses, run_outcomes

PANEL_KEYS = ("site", "region", "procedure")


@dataclass(frozen=True)
class CitationReport:
    """Tables of one report. `outcomes` is written when the report is made; the others read it and stay lazy."""

    outcomes: DataFrame
    panel: DataFrame
    prompts: DataFrame
    findings: DataFrame
    public: DataFrame
    private: DataFrame
    evidence: DataFrame
    answers: DataFrame
    domains: DataFrame


def outcomes_of(responses: DataFrame) -> DataFrame:
    """A3 rows to G7 rows: narrow, no shuffle."""
    return run_outcomes(parse_responses(responses))


def citation_report(
    responses: DataFrame, structure: DataFrame | None = None, keys: Sequence[str] = PANEL_KEYS,
    repeats: int = K.MAX_REPEATS, path: str | None = None,
) -> CitationReport:
    """Everything a panel produces, from raw responses and (optionally) one structure row per site.

    Responses are parsed once: outcomes are written to `path` (by default a folder of this run) and read back.
    """
    outcomes = reuse_outcomes(outcomes_of(responses), path or f"{run_folder(responses.sparkSession)}/outcomes")
    by_engine = panel.citation_panel(outcomes, keys, repeats)
    by_prompt = panel.panel_by_prompt(outcomes, keys)
    if structure is None:
        empty = "site string, score int, band string, needs_render boolean, items array<struct<key:string,status:string,points:int,note:string>>"
        structure = responses.sparkSession.createDataFrame([], empty)
    found = diagnosis.diagnose(diagnosis.site_state(structure, by_engine, keys, by_prompt))
    candidates = panel.compare_candidates(outcomes, keys)
    return CitationReport(
        outcomes=outcomes,
        panel=by_engine,
        prompts=by_prompt,
        findings=diagnosis.findings(found, keys),
        public=views.public_view(by_engine, keys),
        private=views.private_view(by_engine, candidates, keys),
        evidence=panel.panel_evidence(outcomes, keys),
        answers=panel.sample_answers(outcomes, keys),
        domains=panel.share_of_citations(outcomes, keys),
    )


def reuse_outcomes(outcomes: DataFrame, path: str) -> DataFrame:
    """Write the outcomes once and read them back: several reports then share one parse.

    A written table survives lost executors, which a cached one does not.
    """
    outcomes.write.mode("overwrite").parquet(path)
    return outcomes.sparkSession.read.parquet(path)
