"""Raw engine responses to run outcomes. Everything is row-local: no shuffle before the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import col, let, no_nulls, strip, text_or_empty
from ..functions.urls import registrable_domain, same_site

SCHEMAS = {
    "chatgpt": (
        "output ARRAY<STRUCT<type: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING, "
        "annotations: ARRAY<STRUCT<type: STRING, url: STRING>>>>>>, output_text STRING"
    ),
    "claude": (
        "content ARRAY<STRUCT<type: STRING, text: STRING, is_error: BOOLEAN, "
        "citations: ARRAY<STRUCT<type: STRING, url: STRING>>, "
        "content: ARRAY<STRUCT<type: STRING, text: STRING>>>>"
    ),
    "perplexity": (
        "search_results ARRAY<STRUCT<url: STRING>>, citations ARRAY<STRING>, "
        "choices ARRAY<STRUCT<message: STRUCT<content: STRING>>>"
    ),
    "gemini": (
        "candidates ARRAY<STRUCT<groundingMetadata: STRUCT<groundingChunks: "
        "ARRAY<STRUCT<maps: STRUCT<uri: STRING>, web: STRUCT<uri: STRING>>>>, "
        "content: STRUCT<parts: ARRAY<STRUCT<text: STRING>>>>>"
    ),
}


def _parsed(engine: str, response: Column) -> Column:
    return F.from_json(response, SCHEMAS[engine])


def _texts(array: Column) -> Column:
    """Non-empty strings of an array that may be NULL or hold NULLs."""
    return F.coalesce(
        F.filter(array, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>")
    )


def _each(array: Column, f) -> Column:
    """flatten(transform()) over arrays whose members may be NULL."""
    return F.flatten(
        F.transform(array, lambda x: F.coalesce(f(x), F.array().cast("array<string>")))
    )


def _by_engine(engine: Column | str, response: Column | str, read) -> Column:
    """`read(engine name, parsed response)` for the row's engine: one parse per engine in the plan."""
    name, text = col(engine), col(response)
    chain = None
    for known in SCHEMAS:
        found = _bound(known, text, read)
        chain = F.when(name == known, found) if chain is None else chain.when(name == known, found)
    return chain


def _bound(known: str, text: Column, read) -> Column:
    return let(_parsed(known, text), lambda r: read(known, r))


def _urls(known: str, parsed: Column) -> Column:
    def chatgpt(r: Column) -> Column:
        messages = F.filter(r["output"], lambda o: o["type"] == "message")
        return _each(
            messages,
            lambda o: _each(
                o["content"],
                lambda p: F.transform(
                    F.filter(p["annotations"], lambda a: a["type"] == "url_citation"), lambda a: a["url"]
                ),
            ),
        )

    def claude(r: Column) -> Column:
        return _each(
            r["content"],
            lambda b: F.transform(
                F.filter(b["citations"], lambda c: c["type"] == "web_search_result_location"),
                lambda c: c["url"],
            ),
        )

    def perplexity(r: Column) -> Column:
        return F.concat(_texts(F.transform(r["search_results"], lambda s: s["url"])), _texts(r["citations"]))

    def gemini(r: Column) -> Column:
        return _each(
            r["candidates"],
            lambda c: _each(
                c["groundingMetadata"]["groundingChunks"],
                lambda g: F.array(g["maps"]["uri"], g["web"]["uri"]),
            ),
        )

    shapes = {"chatgpt": chatgpt, "claude": claude, "perplexity": perplexity, "gemini": gemini}
    return F.array_distinct(_texts(shapes[known](parsed)))


def cited_urls(engine: Column | str, response: Column | str) -> Column:
    """G1: cited URLs in first-seen order; a malformed response has none."""
    return F.coalesce(_by_engine(engine, response, _urls), F.array().cast("array<string>"))


def _answer(known: str, parsed: Column) -> Column:
    def joined(array: Column) -> Column:
        return strip(F.array_join(_texts(array), "\n"))

    def chatgpt(r: Column) -> Column:
        messages = F.filter(r["output"], lambda o: o["type"] == "message")
        parts = _each(
            messages,
            lambda o: F.transform(
                F.filter(o["content"], lambda p: p["type"].isin("output_text", "text")), lambda p: p["text"]
            ),
        )
        return F.when(F.size(_texts(parts)) > 0, joined(parts)).otherwise(strip(text_or_empty(r["output_text"])))

    def claude(r: Column) -> Column:
        return joined(F.transform(F.filter(r["content"], lambda b: b["type"] == "text"), lambda b: b["text"]))

    def perplexity(r: Column) -> Column:
        return strip(text_or_empty(F.get(r["choices"], F.lit(0))["message"]["content"]))

    def gemini(r: Column) -> Column:
        return joined(
            _each(r["candidates"], lambda c: F.transform(c["content"]["parts"], lambda p: p["text"]))
        )

    shapes = {"chatgpt": chatgpt, "claude": claude, "perplexity": perplexity, "gemini": gemini}
    return text_or_empty(shapes[known](parsed))


def answer_text(engine: Column | str, response: Column | str) -> Column:
    """What the engine answered, '' if nothing."""
    return text_or_empty(_by_engine(engine, response, _answer))


def _tool_error(known: str, parsed: Column) -> Column:
    if known != "claude":
        return F.lit(None).cast("string")
    blocks = F.filter(
        parsed["content"], lambda b: (b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False))
    )

    def text(first: Column) -> Column:
        code = strip(F.array_join(F.transform(first["content"], lambda c: text_or_empty(c["text"])), " "))
        detail = F.when(text_or_empty(code) != "", code).otherwise("web_search_error")
        return F.when(first.isNotNull(), F.concat(F.lit("claude: web_search_tool_result error — "), detail))

    return let(F.get(blocks, F.lit(0)), text)


def tool_error(engine: Column | str, response: Column | str) -> Column:
    """The search tool failed although the call itself succeeded."""
    return _by_engine(engine, response, _tool_error)


def parse_responses(responses: DataFrame) -> DataFrame:
    """G1 to G3 on a response log: adds urls and answer, fills error, drops the raw JSON. Every response is parsed once."""
    def everything(known: str, parsed: Column) -> Column:
        return F.struct(
            _urls(known, parsed).alias("urls"), _answer(known, parsed).alias("answer"), _tool_error(known, parsed).alias("error")
        )

    keep = [c for c in responses.columns if c not in ("response", "error")]
    read = responses.select(*keep, "error", _by_engine("engine", "response", everything).alias("_read"))
    return read.select(
        *keep, F.coalesce(F.col("error"), F.col("_read.error")).alias("error"),
        F.coalesce("_read.urls", F.array().cast("array<string>")).alias("urls"), text_or_empty("_read.answer").alias("answer"),
    )


def mention_position(answer: Column, site: Column) -> Column:
    """Top, mid or tail of the answer, NULL if the domain is not in it."""
    domain = registrable_domain(site)
    needle = F.lower(F.when(domain != "", domain).otherwise(site))
    at = F.instr(F.lower(answer), needle) - 1
    share = at / F.length(answer)
    return F.when(
        (text_or_empty(answer) != "") & (text_or_empty(site) != "") & (at >= 0),
        F.when(share < 0.33, "top").when(share < 0.67, "mid").otherwise("tail"),
    )


def normalize_name(text: Column | str) -> Column:
    """Lower case without blanks and punctuation."""
    return F.regexp_replace(F.lower(text_or_empty(text)), K.NAME_NOISE, "")


def names_mentioned(answer: Column | str, names: Column | str) -> Column:
    """One of the names is in the answer. Names shorter than three characters do not count."""
    candidates = F.filter(
        F.transform(
            F.filter(F.transform(col(names), lambda n: strip(text_or_empty(n))), lambda n: F.length(n) >= 2),
            normalize_name,
        ),
        lambda n: F.length(n) >= 3,
    )
    return F.coalesce(
        let(normalize_name(answer), lambda hay: F.exists(candidates, lambda n: hay.contains(n))), F.lit(False)
    )


def match_citations(runs: DataFrame, site: str = "site", urls: str = "urls") -> DataFrame:
    """Matched URLs, citation count, distinct cited domains; measured = something was cited."""
    cited = F.coalesce(F.col(urls), F.array().cast("array<string>"))
    return (
        runs.withColumn(
            "matched_urls",
            let(registrable_domain(site), lambda d: F.filter(cited, lambda u: same_site(u, d))),
        )
        .withColumn("citation_count", F.size(cited))
        .withColumn("cited_domains", F.array_distinct(F.transform(cited, lambda u: registrable_domain(u))))
        .withColumn("measured_citations", F.size(cited) > 0)
    )


def classify(error: Column, measured: Column) -> Column:
    """Error before inconclusive (nothing cited) before valid."""
    return F.when(error.isNotNull(), "error").when(~F.coalesce(measured, F.lit(False)), "inconclusive").otherwise("valid")


def run_outcomes(parsed: DataFrame, site: str = "site", names: str = "names") -> DataFrame:
    """The outcome row of every run."""
    matched = match_citations(parsed, site)
    status = classify(F.col("error"), F.col("measured_citations"))
    return (
        matched.withColumn("status", status)
        .withColumn("cited", (F.col("status") == "valid") & (F.size("matched_urls") > 0))
        .withColumn("named", (F.col("status") != "error") & names_mentioned("answer", names))
        .withColumn("position", mention_position(F.col("answer"), F.col(site)))
    )


def as_response(
    engine: Column | str, urls: Column | str, answer: Column | str
) -> Column:
    """The raw JSON an engine would have sent for these URLs and this answer (replay and tests)."""
    name, links, text = col(engine), col(urls), col(answer)

    def cites(kind: str) -> Column:
        return F.transform(links, lambda u: F.struct(F.lit(kind).alias("type"), u.alias("url")))

    chatgpt = F.to_json(F.struct(no_nulls(F.struct(
        F.lit("message").alias("type"),
        F.array(F.struct(
            F.lit("output_text").alias("type"), text.alias("text"), cites("url_citation").alias("annotations")
        )).alias("content"),
    )).alias("output")))
    claude = F.to_json(F.struct(F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), cites("web_search_result_location").alias("citations")
    )).alias("content")))
    perplexity = F.to_json(F.struct(
        F.transform(links, lambda u: F.struct(u.alias("url"))).alias("search_results"),
        F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"),
    ))
    return F.when(name == "chatgpt", chatgpt).when(name == "claude", claude).when(name == "perplexity", perplexity)

