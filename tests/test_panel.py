"""Responses, panel, views, diagnosis, comparison: rules and invariants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from citescope.functions.stats import wilson
from citescope.operators import compare, diagnosis, panel, scoring, views
from citescope.operators.responses import parse_responses, run_outcomes
from citescope.plans.citation import citation_report, outcomes_of

KEYS = ["site", "region", "procedure"]


def chatgpt(urls, text=""):
    part = {"type": "output_text", "text": text, "annotations": [{"type": "url_citation", "url": u} for u in urls] + [{"type": "x", "url": "no"}]}
    return json.dumps({"output": [{"type": "web_search_call"}, {"type": "message", "content": [part]}]})


RESPONSES = [
    ("chatgpt", chatgpt(["https://www.haru.co.kr/a", "https://other.co.kr/x", "https://haru.co.kr/b"], "haru.co.kr 추천 " + "x" * 300)),
    ("claude", json.dumps({"content": [{"type": "text", "text": "서울 스마일-치과", "citations": [{"type": "web_search_result_location", "url": "https://o.com/"}]}]})),
    ("claude", json.dumps({"content": [{"type": "tool_result", "is_error": True, "content": [{"type": "text", "text": "too_many_requests"}]}]})),
    ("perplexity", json.dumps({"search_results": [{"url": "https://haru.co.kr"}], "citations": ["https://news.x/y", "https://haru.co.kr"],
                               "choices": [{"message": {"content": " hi "}}]})),
    ("gemini", json.dumps({"candidates": [{"groundingMetadata": {"groundingChunks": [{"maps": {"uri": "https://m/"}}, {"web": {"uri": "https://haru.co.kr"}}]},
                                           "content": {"parts": [{"text": "a"}, {"text": "b"}]}}]})),
    ("chatgpt", "not json"), ("perplexity", json.dumps({"search_results": "bad"})), ("chatgpt", json.dumps({"output": [], "output_text": " fallback "})),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, "haru.co.kr", ["서울스마일치과", "x"], e, "p", r, None) for i, (e, r) in enumerate(RESPONSES)]
    df = spark.createDataFrame(rows, "run_ord bigint, site string, names array<string>, engine string, prompt string, response string, error string")
    return {r["run_ord"]: r for r in run_outcomes(parse_responses(df)).collect()}


def test_parse(parsed):
    assert parsed[0]["urls"] == ["https://www.haru.co.kr/a", "https://other.co.kr/x", "https://haru.co.kr/b"]
    assert parsed[3]["urls"] == ["https://haru.co.kr", "https://news.x/y"] and parsed[3]["answer"] == "hi"
    assert parsed[4]["urls"] == ["https://m/", "https://haru.co.kr"] and parsed[4]["answer"] == "a\nb"
    assert parsed[5]["urls"] == [] and parsed[6]["urls"] == [] and parsed[7]["answer"] == "fallback"
    assert parsed[2]["error"] == "claude: web_search_tool_result error — too_many_requests"


def test_outcomes(parsed):
    assert parsed[0]["cited"] and len(parsed[0]["matched_urls"]) == 2 and parsed[0]["position"] == "top"
    assert parsed[0]["cited_domains"] == ["haru.co.kr", "other.co.kr"]
    assert parsed[1]["named"] and not parsed[1]["cited"] and parsed[1]["status"] == "valid"
    assert parsed[2]["status"] == "error" and not parsed[2]["named"]
    assert parsed[5]["status"] == "inconclusive" and parsed[5]["position"] is None


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (5, 5)], "h int, n int").select(wilson("h", "n").alias("w"))
    none, low, high = [r["w"] for r in df.collect()]
    assert none is None and low["low"] == 0 and low["high"] > 0 and high["high"] == 1 and high["low"] < 1


def random_outcomes(spark, n=3000):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        site = "hot.example" if rng.random() < 0.34 else f"s{rng.randrange(40)}.example"
        status = rng.choice(["error", "inconclusive", "valid", "valid", "valid"])
        cited = status == "valid" and rng.random() < 0.3
        rows.append((site, "r", "p", rng.choice(["chatgpt", "claude"]), f"q{rng.randrange(5)}", i, status, cited, status != "error" and rng.random() < 0.2,
                     "top", ["https://x/"] if cited else [], ["a.com", f"d{rng.randrange(30)}.com"], "text", None))
    return spark.createDataFrame(rows, "site string, region string, procedure string, engine string, prompt string, run_ord bigint, status string, "
                                 "cited boolean, named boolean, position string, matched_urls array<string>, cited_domains array<string>, answer string, error string")


def test_panel_invariants(spark):
    outcomes = random_outcomes(spark)
    rows = panel.citation_panel(outcomes, KEYS).collect()
    assert sum(r["attempts"] for r in rows) == 3000
    for r in rows:
        assert r["attempts"] == r["valid_runs"] + r["errored_runs"] + r["inconclusive_runs"]
        assert (r["ci_low"] is None) == (r["cited_runs"] == 0 or r["valid_runs"] < 2)
        if r["ci_low"] is not None:
            assert r["ci_low"] <= r["cited_runs"] / r["valid_runs"] <= r["ci_high"]
        if r["prompts_scored"]:
            assert r["prompts_scored"] == r["always_cited"] + r["never_cited"] + r["sometimes_cited"]
    by_engine = {(r["site"], r["engine"]): r for r in panel.panel_by_engine(outcomes, KEYS).collect()}
    assert all(by_engine[r["site"], r["engine"]]["hit_rate"] == r["hit_rate"] for r in rows)


def test_unmeasured_is_not_zero(spark):
    df = random_outcomes(spark).where("status != 'valid'")
    for r in panel.citation_panel(df, KEYS).collect():
        assert not r["measured"] and r["unmeasurable"] in ("engine-error", "no-search") and r["ci_low"] is None and r["spread"] is None
    for r in panel.panel_by_prompt(df, KEYS).collect():
        assert r["rate"] is None


def test_public_view_hides(spark):
    outcomes = random_outcomes(spark)
    public = views.public_view(panel.citation_panel(outcomes, KEYS), KEYS)
    assert not {"cited_domains", "matched_urls", "evidence", "answer", "compare_candidates"} & set(public.columns)
    assert views.leak_scan(public, "site").count() == 0
    leaky = public.withColumn("x", F.lit("see https://rival.example/a"))
    assert views.leak_scan(leaky, "site").count() == public.count()


def test_share_ranks_match_brute_force(spark):
    outcomes = random_outcomes(spark)
    share = panel.share_of_citations(outcomes, ["site"]).where("site = 'hot.example' and engine = 'claude'").collect()
    for r in share:
        assert r["share_rank"] == 1 + sum(o["runs"] > r["runs"] for o in share)
    assert max(share, key=lambda r: r["runs"])["domain"] == "a.com"


def _engine(**kw):
    base = dict(site="s", engine="chatgpt", valid_runs=3, cited_runs=0, named_runs=0, measured=True, exposed=False, unmeasurable=None)
    return tuple({**base, **kw}.values())


ENGINE = "site string, engine string, valid_runs bigint, cited_runs bigint, named_runs bigint, measured boolean, exposed boolean, unmeasurable string"


def _structure(spark, score=80, crawl="ok", points=5):
    items = [(k, crawl if k == "crawl" else "ok", points, k + " note") for k in ("crawl", "extract", "citable", "price", "fresh")]
    return spark.createDataFrame([("s", score, "b", False, items)],
                                 "site string, score int, band string, needs_render boolean, items array<struct<key:string,status:string,points:int,note:string>>")


@pytest.mark.parametrize(
    "structure, engine, codes, headline",
    [
        ({}, dict(valid_runs=0, measured=False, unmeasurable="no-search"), ["not-measured"], "미측정"),
        ({"crawl": "fail"}, {}, ["crawl-blocked"], "필요조건"),
        ({}, dict(named_runs=2, exposed=True), ["named-not-linked"], "노출됐습니다"),
        ({}, {}, ["structure-ok-not-exposed"], "나오지 않았습니다"),
        ({"score": 69}, {}, [], "나오지 않았습니다"),
        ({"crawl": "fail", "points": 0}, {}, ["crawl-blocked", "no-citable-evidence", "no-price", "no-date"], "필요조건"),
    ],
)
def test_diagnosis(spark, structure, engine, codes, headline):
    rows = spark.createDataFrame([_engine(**engine)], ENGINE)
    r = diagnosis.diagnose(diagnosis.site_state(_structure(spark, **structure), rows, ["site"])).first()
    assert [f["code"] for f in r["findings"]] == codes and headline in r["headline"]


def test_diagnosis_without_panel(spark):
    r = diagnosis.structure_findings(_structure(spark, points=0)).first()
    assert [f["severity"] for f in r["findings"]] == ["high", "medium", "medium"] and r["headline"].startswith("구조 진단")


def test_report_end_to_end(spark, folder):
    from citescope.sources.readers import read_engine_responses

    lines = []
    for i, (engine, response) in enumerate(RESPONSES * 3):
        lines.append(json.dumps({"run_id": i, "run_ord": i, "ts": "2026-01-01T00:00:00Z", "site": "haru.co.kr", "names": ["서울스마일치과"], "region": "강남",
                                 "procedure": "임플란트", "engine": engine, "prompt": f"q{i % 2}", "rep": 1, "response": response}))
    with open(f"{folder}/r.json", "w") as f:
        f.write("\n".join(lines))
    responses = read_engine_responses(spark, folder)
    report = citation_report(responses, _structure(spark).withColumn("site", F.lit("haru.co.kr")))
    rows = {r["engine"]: r for r in report.panel.collect()}
    assert rows["chatgpt"]["cited_runs"] == 3 and rows["claude"]["errored_runs"] == 3 and rows["claude"]["named_runs"] == 3
    assert report.findings.count() >= 0 and report.private.where("view = 'private'").count() == len(rows)
    assert views.leak_scan(report.public, "site").count() == 0
    assert {r["kind"] for r in report.evidence.collect()} == {"error", "inconclusive", "matched"}
    assert outcomes_of(responses).count() == len(lines)


def test_compare_package(spark):
    rich = dict(h1_count=1, h2_count=5, credentials=6, date_signals=3, sn=0.1, scripts=5, has_statistics=True, has_quotations=True, has_cited_sources=True)
    poor = {k: (False if isinstance(v, bool) else 0 * v) for k, v in rich.items()}
    rows = spark.createDataFrame([("u", *poor.values()), ("c", *rich.values())], ["k", *rich])
    fields = ("name", "telephone", "address", "openingHours", "geo", "sameAs", "priceRange", "areaServed", "medicalSpecialty")
    flags = [(F.col("k") == "c").alias(n) for n in fields]
    profile = rows.select(
        "*", F.struct(F.array(F.lit("Dentist")).alias("types"), (F.col("k") == "c").alias("has_dental"), F.lit(0).alias("faq_count"), F.lit(1).alias("rating"),
                      F.lit(False).alias("has_breadcrumb"), F.struct(*flags).alias("entity")).alias("jsonld"),
        *[F.lit("x").alias(c) for c in ("title", "meta_description", "og_title", "og_image", "canonical", "viewport", "robots_meta")],
        *[F.lit(0).alias(c) for c in ("question_h2", "tables", "faq_blocks", "visible_len")],
    )
    scored = scoring.page_scores(profile, profile.columns)
    pairs = spark.createDataFrame([("u", "c", False)], "user_key string, comp_key string, user_cited boolean")
    r = compare.compare_package(compare.pair_profiles(pairs, scored, "k"), ["user_key", "comp_key"], "user_cited").first()
    plan = [x["key"] for x in r["plan_rows"]]
    assert plan[0] == "notcited" and "price" not in plan and "citability" in plan
    assert len(r["schema_summary"]["missing"]) == 9 and "geo-renewal" in r["solutions"]
    assert r["recommended_products"][:3] == ["blog-posting", "media-feature", "reboot-30"]
    assert len(r["signal_diff"]) == 8


def test_hit_map_keeps_failures(spark):
    outcomes = random_outcomes(spark, 300)
    failures = spark.createDataFrame([("lost", "timeout")], "region string, error string")
    rows = {r["region"]: r for r in panel.hit_map(panel.panel_by_engine(outcomes, ["region"]), ["region"], failures=failures).collect()}
    assert rows["lost"]["error"] == "timeout" and rows["lost"]["chatgpt"] is None and "/" in rows["r"]["chatgpt"] and rows["r"]["perplexity"] is None
