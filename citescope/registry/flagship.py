"""The flagship: pages scored end to end, beside the citation panel of their site."""

from pyspark.sql import functions as F

from ..operators import panel
from ..plans.audit import audit
from . import beds
from .core import page_table, query
from .pages import AUDIT


def scored_pages_with_panel(spark, sf):
    """Score, band and top fix per page, with the rates of the runs that asked about its site."""
    scored = audit(page_table(spark, sf)).select(
        "page_id", "domain", F.col("score").cast("bigint").alias("score"), "band", F.get("top_fixes", F.lit(0))["key"].alias("top_fix")
    )
    runs = beds.url_runs(spark, sf)
    outcomes = runs.select(
        "run_ord", "site", "engine", "prompt", F.when(F.col("run_ord") % 7 == 0, "inconclusive").otherwise("valid").alias("status"),
        F.exists("urls", lambda u: u.contains(F.concat(F.lit("."), F.col("site")))).alias("cited"), F.lit(False).alias("named"),
    )
    sites = panel.panel_by_engine(outcomes, ["site"]).groupBy(F.col("site").alias("domain")).agg(
        F.sum("valid_runs").alias("valid_runs"), F.sum("cited_runs").alias("cited_runs"), F.bool_or("exposed").alias("exposed")
    )
    return scored.join(sites, "domain", "left")


@query("flagship", f"""WITH {AUDIT}, {beds.URL_RUNS},
runs AS (SELECT run_ord, site, run_ord % 7 <> 0 AS valid, bool_or(contains(url, '.' || site)) AS cited FROM cites GROUP BY run_ord, site),
sites AS (SELECT site, count(*) FILTER (valid) AS valid_runs, count(*) FILTER (valid AND cited) AS cited_runs FROM runs GROUP BY site)
SELECT page_id, site AS domain, tech_score + content_score AS score,
  CASE WHEN tech_score + content_score >= 30 THEN '개선 여지 큼' ELSE '초기 단계' END AS band,
  CASE WHEN render THEN 'schema' WHEN eeat_points = 0 THEN CASE WHEN citable = 0 THEN 'eeat' WHEN citable < 15 THEN 'eeat' END ELSE 'citable' END AS top_fix,
  CAST(valid_runs AS BIGINT) AS valid_runs, CAST(cited_runs AS BIGINT) AS cited_runs, cited_runs > 0 AS exposed
FROM audited JOIN sites ON site = regexp_extract(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '([^.]+\\.[^.]+)$', 1)""")
def flagship(spark, sf):
    return scored_pages_with_panel(spark, sf)
