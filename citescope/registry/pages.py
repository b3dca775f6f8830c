"""Page signals over the pages table, on its own and with fragments added per page."""

from pyspark.sql import functions as F

from ..operators import scoring, signals
from ..operators.shred import explode_nodes, shred_pages
from ..plans import audit as audit_plan
from .core import page_table, query, table

def _decoded(text: str) -> str:
    """SQL for the entities these pages use; a cut-off one without its semicolon counts as well."""
    for name, sign in (("nbsp", "chr(160)"), ("quot", "chr(34)"), ("copy", "'©'"), ("middot", "'·'"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")):
        text = f"regexp_replace({text}, '&{name};?', {sign}, 'g')"
    return text


# Visible text as SQL: tags go, entities are decoded, white space shrinks. Exact for these pages:
# their markup holds no `<` in text and these entities only.
_STRIPPED = r"""regexp_replace(regexp_replace(substring(html, instr(html, '<body')),
        '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?s)<[^>]+>', '', 'g')"""
VISIBLE = rf"""
vis AS (
  SELECT page_id, url, html, trim(regexp_replace({_decoded(_STRIPPED)}, '[\s\x{{00a0}}]+', ' ', 'g')) AS visible
  FROM pages)
"""


@query("visible_text", f"WITH {VISIBLE} SELECT page_id, length(visible) AS visible_len, md5(visible) AS text_hash FROM vis")
def visible_text(spark, sf):
    s = signals.page_signals(page_table(spark, sf))
    return s.select("page_id", F.col("visible_len").cast("bigint").alias("visible_len"), F.md5("visible_text").alias("text_hash"))


@query("text_ratio", f"""WITH {VISIBLE}
SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<script\\b')) AS BIGINT) AS scripts,
  round(CAST(length(visible) AS DOUBLE) / length(html), 3) AS sn, length(visible) < 500 AS needs_render FROM vis""")
def text_ratio(spark, sf):
    s = signals.page_signals(page_table(spark, sf))
    return s.select("page_id", F.col("scripts").cast("bigint").alias("scripts"), "sn", "needs_render")


@query("answer_first", f"""WITH {VISIBLE}, t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'AI는 ' WHEN 1 THEN 'AI는X ' WHEN 2 THEN repeat('x', 239) || '가Y' ELSE '' END || visible AS t FROM vis)
SELECT page_id, page_id % 4 = 1 AND length(t) > 80 AS answer_first FROM t""")
def answer_first(spark, sf):
    """Only a particle between two ASCII word characters counts, and only within the first 240 characters."""
    n = F.col("page_id") % 4
    text = F.concat(
        F.when(n == 0, "AI는 ").when(n == 1, "AI는X ").when(n == 2, F.concat(F.repeat(F.lit("x"), 239), F.lit("가Y"))).otherwise(""), "visible_text"
    )
    return signals.page_signals(page_table(spark, sf)).select("page_id", signals.answer_first(text).alias("answer_first"))


@query("heading_counts", rf"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<h1[^>]*>(.*?)</h1>', 1) AS hs FROM pages)
SELECT page_id, CAST(len(list_filter(hs, lambda x: trim(x) <> '')) AS BIGINT) AS h1_count, CAST(0 AS BIGINT) AS h2_count,
  trim({_decoded("hs[1]")}) AS first_h1 FROM h""")
def heading_counts(spark, sf):
    s = signals.page_signals(page_table(spark, sf))
    return s.select(
        "page_id", F.col("h1_count").cast("bigint").alias("h1_count"), F.col("h2_count").cast("bigint").alias("h2_count"),
        F.get("h1_sample", F.lit(0)).alias("first_h1"),
    )


@query("element_counts", r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<li')) AS BIGINT) AS items,
  CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS scripts
FROM pages""")
def element_counts(spark, sf):
    rows = explode_nodes(shred_pages(page_table(spark, sf)), "page_id")
    count = lambda tag: F.count_if(F.col("tag") == tag)
    return rows.groupBy("page_id").agg(
        count("a").alias("links"), count("li").alias("items"), count("p").alias("paragraphs"), count("script").alias("scripts")
    )


@query("name_guess", rf"""
SELECT page_id, substring(trim(regexp_extract(t, '^[^|–—:·ㅣ-]*')), 1, 40) AS name_guess FROM (
  SELECT page_id, substring(trim(regexp_replace({_decoded("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')), 1, 300) AS t FROM pages)""")
def name_guess(spark, sf):
    return signals.page_signals(page_table(spark, sf)).select("page_id", "name_guess")


@query("teardown", r"""
SELECT page_id, substring(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), 1, 200) AS title,
  substring(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 900) AS body_text,
  CAST(0 AS BIGINT) AS metas FROM pages""")
def teardown(spark, sf):
    t = signals.teardown("html")
    rows = page_table(spark, sf).select("page_id", t.alias("t"))
    return rows.select("page_id", "t.title", "t.body_text", F.size("t.metas").cast("bigint").alias("metas"))


_WORDS = [("common", "common", ["the", "and"]), ("german", "german", ["und", "der", "die"]), ("french", "french", ["que", "les"]),
          ("rare", "rare", ["zebra"]), ("tied", "tied", ["and", "the"])]


@query("procedure_hits", r"""
WITH w(q, kw, o) AS (VALUES ('common', ['the', 'and'], 0), ('german', ['und', 'der', 'die'], 1), ('french', ['que', 'les'], 2), ('rare', ['zebra'], 3), ('tied', ['and', 'the'], 4)),
c AS (SELECT doc_id, q, o, list_sum(list_transform(kw, lambda k: len(regexp_extract_all(text, '(?i)' || k)))) AS hits FROM documents, w)
SELECT doc_id, q, CAST(hits AS BIGINT) AS hits, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, o) AS place FROM c WHERE hits > 0""")
def procedure_hits(spark, sf):
    hits = signals.procedure_hits("text", _WORDS)
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(hits).alias("i", "h"))
    return d.select("doc_id", "h.q", F.col("h.hits").cast("bigint").alias("hits"), (F.col("i") + 1).cast("bigint").alias("place"))


@query("text_patterns", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, 'DDS|DMD|the')) AS BIGINT) AS credentials,
  regexp_matches(text, '0\d{1,2}[-.\s]?\d{3,4}[-.\s]?\d{4}') AS phone, regexp_matches(text, '\[\d+\]') AS footnote,
  regexp_matches(text, '(?i)(maps\.google\.|google\.com/maps|place_id=)') AS map_embed FROM documents""")
def text_patterns(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", signals.credential_hits("text", "DDS|DMD|the").cast("bigint").alias("credentials"),
        signals.phone_in("text").alias("phone"), F.col("text").rlike(r"\[\d+\]").alias("footnote"),
        signals.has_map_embed("text").alias("map_embed"),
    )


# --- the whole chain ----------------------------------------------------------------------------

# What these pages can score: no robots file, no JSON-LD, no price, no dates, no h2, table or list
# of questions; text signals by pattern.
AUDIT = VISIBLE + r""",
marks AS (
  SELECT page_id, url, length(visible) AS n, CAST(length(visible) AS DOUBLE) / length(html) AS ratio,
    len(regexp_extract_all(html, '(?i)<script\b')) AS scripts,
    regexp_matches(visible, '0\d{1,2}[-.\s]?\d{3,4}[-.\s]?\d{4}') AS phone,
    len(regexp_extract_all(visible, '전문의|치의학박사|박사|원장|면허|교수|DDS|DMD|레지던트|수련의')) AS creds,
    regexp_matches(visible, '\[\d+\]') OR regexp_matches(visible, '(?i)(^|[^a-z0-9_])(references?|sources?)\s*[:：]|(^|[^a-z0-9_])bibliography([^a-z0-9_]|$)') AS sourced,
    regexp_matches(visible, '"[^"]{20,300}"') AS quoted,
    len(list_distinct(list_transform(regexp_extract_all(visible, '\d[\d,]*(?:\.\d+)?\s*(?:%p|%|퍼센트포인트|퍼센트|배|명|건|례)|\d[\d,]*(?:\.\d+)?\s*(?:mm|cm|mg|ml)([^A-Za-z]|$)'), lambda x: replace(x, ' ', '')))) AS stats,
    regexp_matches(html, '<h1[^>]*>\s*[^<\s]') AS h1
  FROM vis),
audit AS (
  SELECT page_id, url, n < 500 AS render,
    CASE WHEN round(ratio, 3) >= 0.06 THEN 6 WHEN round(ratio, 3) >= 0.02 THEN 3 ELSE 0 END
      + CASE WHEN scripts <= 25 THEN 4 WHEN scripts <= 50 THEN 2 ELSE 0 END AS reads,
    phone::INT * 4 AS local_, CASE WHEN creds >= 4 THEN 10 WHEN creds >= 1 THEN 6 ELSE 0 END AS eeat,
    h1::INT * 2 AS answer, sourced::INT * 7 + quoted::INT * 4 + CASE WHEN stats >= 3 THEN 4 WHEN stats >= 1 THEN 2 ELSE 0 END AS citable
  FROM marks),
audited AS (
  SELECT page_id, url, render, CAST(11 + CASE WHEN render THEN least(2, reads) ELSE reads END + local_ AS BIGINT) AS tech_score,
    CAST(eeat + answer + citable AS BIGINT) AS content_score, citable, eeat AS eeat_points
  FROM audit)
"""


# --- pages with one more fragment each, and what it must add -----------------------------------
# (html, expected question h2, tables, faq blocks, date signals, price band, quotes, cited sources, forms, social links)
_LD = '<script type="application/ld+json">'
FRAGMENTS = [
    ("<h2>보철은 며칠 걸리나요?</h2>", 1, 0, 0, 0, 0, False, False, 0, 0),
    ("<h2>시술 다음 날 할 일</h2><h2>치과위생사 한솔</h2>", 0, 0, 0, 0, 0, False, False, 0, 0),
    ("<table><tr><td>틀니</td><td>950,000원</td></tr></table>", 0, 1, 0, 0, 2, False, False, 0, 0),
    ("<ul><li>라미네이트 40만원</li><li>인레이 18만원</li></ul>", 0, 0, 0, 0, 1, False, False, 0, 0),
    ("<p>교정 문의 053-555-0199</p>", 0, 0, 0, 0, 0, False, False, 0, 0),
    ("<details><summary>처음 오신 분</summary>접수대</details><dl><dt>k<dd>v</dl>", 0, 0, 2, 0, 0, False, False, 0, 0),
    ('<time datetime="2025-11-03">y</time>' + _LD + '{"@type":"Article","datePublished":"2025-11-03",}</script>', 0, 0, 0, 2, 0, False, False, 0, 0),
    ("<blockquote>마취가 풀릴 때까지 씹지 마세요.</blockquote>", 0, 0, 0, 0, 0, True, False, 0, 0),
    ('<div class="testimonial"><blockquote>설명이 자세해서 편했어요 추천합니다</blockquote><cite>박OO 씨</cite></div>', 0, 0, 0, 0, 0, False, False, 0, 0),
    ("<p>지침 (<cite>보존학회지, 2023</cite>)</p>", 0, 0, 0, 0, 0, False, True, 0, 0),
    ('<p><a href="https://www.koreamed.org/x">근거</a></p>', 0, 0, 0, 0, 0, False, True, 0, 0),
    ('<form id="booking"><label for="w">성함</label><input id="w"><button type="submit">보내기</button></form>', 0, 0, 0, 0, 0, False, False, 1, 0),
    ("<h3>인용 문헌</h3><p>지침</p>", 0, 0, 0, 0, 0, False, True, 0, 0),
    ('<p><a href="https://pf.kakao.com/solip">채널</a></p>', 0, 0, 0, 0, 0, False, False, 0, 1),
]


def _with_fragment(spark, sf):
    fragment = F.element_at(F.array(*[F.lit(f[0]) for f in FRAGMENTS]), (F.col("page_id") % len(FRAGMENTS) + 1).cast("int"))
    return page_table(spark, sf).select("page_id", "url", F.concat("html", fragment).alias("html"))


def _expected() -> str:
    rows = ", ".join("(" + ", ".join([str(i), *[str(x) for x in f[1:]]]) + ")" for i, f in enumerate(FRAGMENTS))
    return f"e(i, question_h2, tables, faq_blocks, date_signals, price_band, quotes, sources, forms, social) AS (VALUES {rows})"


# The page's own text may quote and cite as well: see `marks`.
@query("fragment_signals", f"""WITH {AUDIT}, {_expected()}
SELECT page_id, question_h2, tables, faq_blocks, date_signals, price_band, quotes OR quoted AS has_quotations,
  sources OR sourced AS has_cited_sources, forms, social
FROM marks JOIN e ON page_id % {len(FRAGMENTS)} = e.i""")
def fragment_signals(spark, sf):
    s = signals.page_signals(_with_fragment(spark, sf))
    return s.select(
        "page_id", "question_h2", "tables", "faq_blocks", "date_signals", "price_band", "has_quotations", "has_cited_sources",
        F.col("forms.forms").alias("forms"), "social",
    )


# --- pages that end misnested: what browsers make of them --------------------------------------
# (html, quotes, distinct outside hosts, form controls, named ones)
_QUOTE = "<blockquote>설명이 자세해서 마음 놓고 다녀왔습니다 추천해요</blockquote>"
MISNESTED = [
    (f"<table><tr><div class=testimonials>{_QUOTE}</div><td>x</table>", False, 0, 0, 0),
    (f"<table><tr><td><div class=testimonials>x<td>{_QUOTE}</table>", True, 0, 0, 0),
    ("<p><a href='https://one.example.org/'>1<p>2</a><p><a href='https://two.example.net/'>3</a></p>", False, 2, 0, 0),
    ("<form><table><label>성함 <input name=n></label><tr><td><input name=m></table></form>", False, 0, 2, 1),
    ("<nav><table><p><a href='https://one.example.org/'>1</a></table></nav><b>x<p><a href='https://two.example.net/'>2</b></a></p>", False, 1, 0, 0),
]
_REPAIRED = ", ".join("(" + ", ".join([str(i), *[str(x) for x in f[1:]]]) + ")" for i, f in enumerate(MISNESTED))


@query("misnested_signals", f"""WITH {AUDIT}, e(i, quotes, hosts, controls, named) AS (VALUES {_REPAIRED})
SELECT page_id, quotes OR quoted AS has_quotations, hosts AS source_link_count, controls AS controls_total, named AS controls_named
FROM marks JOIN e ON page_id % {len(MISNESTED)} = e.i""")
def misnested_signals(spark, sf):
    end = F.element_at(F.array(*[F.lit(f[0]) for f in MISNESTED]), (F.col("page_id") % len(MISNESTED) + 1).cast("int"))
    s = signals.page_signals(page_table(spark, sf).select("page_id", "url", F.concat("html", end).alias("html")))
    return s.select("page_id", "has_quotations", "source_link_count", "forms.controls_total", "forms.controls_named")


@query("form_readiness", f"""SELECT page_id,
  CASE WHEN page_id % {len(FRAGMENTS)} = 11 THEN 'measured' ELSE 'no-form' END AS status,
  CASE WHEN page_id % {len(FRAGMENTS)} = 11 THEN 3 END AS passed FROM pages""")
def form_readiness(spark, sf):
    s = signals.page_signals(_with_fragment(spark, sf)).withColumn("needs_render", F.lit(False))
    return scoring.agent_readiness(s, ["page_id"]).select("page_id", "status", "passed")


_PLACES = [
    ("대구 수성구 달구벌대로 88", "대구", "수성구", "수성"), ("대전광역시 유성구 대학로 5", "대전", "유성구", "유성"),
    ("경남 창원시 성산구 원이대로 12", "경남", "성산구", "성산"), ("경기 광주시 회안대로 7", "경기", "광주시", "광주"),
    ("대구 중구 국채보상로 2", "대구", "중구", "중구"), ("세종특별자치시 도움로 11", "세종", "", "세종"),
]


@query("location_guess", "WITH e(i, sido, district, region) AS (VALUES " + ", ".join(
    f"({i}, '{s}', '{d}', '{r}')" for i, (_, s, d, r) in enumerate(_PLACES)) + f""")
SELECT page_id, sido, district, region, TRUE AS address FROM pages JOIN e ON page_id % {len(_PLACES)} = e.i""")
def location_guess(spark, sf):
    address = F.element_at(F.array(*[F.lit(p[0]) for p in _PLACES]), (F.col("page_id") % len(_PLACES) + 1).cast("int"))
    p = page_table(spark, sf).select("page_id", "url", F.concat("html", F.lit("<p>오시는 길: "), address, F.lit("</p>")).alias("html"))
    s = signals.page_signals(p)
    return s.select("page_id", "location.sido", "location.district", "location.region", "address")


@query("jsonld_profile", """
SELECT page_id, page_id % 3 = 0 AS has_dental, page_id % 3 = 1 AS has_faq, page_id % 3 <> 1 AS has_telephone,
  CASE WHEN page_id % 3 = 1 THEN page_id % 5 ELSE 0 END AS faq_count,
  CASE WHEN page_id % 3 = 2 THEN '4.' || (page_id % 10) END AS rating, page_id % 3 = 0 AS has_same_as_authority FROM pages""")
def jsonld_profile(spark, sf):
    n = F.col("page_id")
    open_, close = F.lit(_LD), F.lit("</script>")
    text = n.cast("string")
    dental = F.concat(F.lit('{"@context":"https://schema.org","@graph":[{"@type":"Dentist","name":"c'), text, F.lit(
        '","telephone":"02-1","sameAs":["https://www.wikidata.org/wiki/Q'), text, F.lit('"]}]}'))
    questions = F.array_join(F.transform(F.sequence(F.lit(1), (n % 5).cast("int")), lambda i: F.lit('{"@type":"Question"}')), ",")
    faq = F.concat(F.lit('{"@type":"FAQPage","mainEntity":['), F.when(n % 5 > 0, questions).otherwise(""), F.lit("]}"))
    rated = F.concat(F.lit('{"@type":"Organization","telephone":"02-2","aggregateRating":{"@type":"AggregateRating","ratingValue":"4.'),
                     (n % 10).cast("string"), F.lit('"},}'))
    ld = F.when(n % 3 == 0, dental).when(n % 3 == 1, faq).otherwise(rated)
    p = page_table(spark, sf).select("page_id", "url", F.concat("html", open_, ld, close).alias("html"))
    j = signals.page_signals(p)
    return j.select(
        "page_id", "jsonld.has_dental", "jsonld.has_faq", "jsonld.has_telephone", F.col("jsonld.faq_count").cast("bigint").alias("faq_count"),
        "jsonld.rating.value", "jsonld.has_same_as_authority",
    ).withColumnRenamed("value", "rating")


@query("section_profile", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.0 END AS section_profile FROM pages""")
def section_profile(spark, sf):
    block = lambda n: F.concat(F.lit("<div>"), F.repeat(F.lit("가"), n), F.lit("</div>"))
    n = F.col("page_id") % 3
    body = (
        F.when(n == 0, F.concat(F.lit("<h2>a</h2>"), block(300), F.lit("<h2>b</h2>"), block(10)))
        .when(n == 1, F.concat(F.lit("<h2>a</h2>"), block(125), block(125)))
        .otherwise(F.concat(F.lit("<h2>a</h2>"), block(901)))
    )
    p = page_table(spark, sf).select("page_id", "url", F.concat(F.lit("<body><section>"), body, F.lit("</section>"), "html").alias("html"))
    return signals.page_signals(p).select("page_id", "section_profile")


@query("head_meta", r"""
SELECT page_id, 'About ' || url AS meta_description, url AS canonical, 'noindex' AS robots_meta, substring(url, 1, 200) AS viewport FROM pages""")
def head_meta(spark, sf):
    u = F.replace("url", F.lit("&"), F.lit("&amp;"))
    head = F.concat(
        F.lit('<head><META NAME="Description" CONTENT="About '), u, F.lit('"><link rel="Canonical" href=" '), u,
        F.lit(' "><meta name=robots content=noindex><meta name="viewport" content="'), u, F.lit('">'),
    )
    p = page_table(spark, sf).select("page_id", "url", F.replace("html", F.lit("<head>"), head).alias("html"))
    return signals.page_signals(p).select("page_id", "meta_description", "canonical", "robots_meta", "viewport")


@query("audit", f"""WITH {AUDIT}
SELECT page_id, tech_score, content_score, tech_score + content_score AS score, render AS needs_render,
  CASE WHEN NOT render AND citable = 0 THEN 'no-citable-evidence' WHEN render THEN 'measurement-limited' ELSE '' END AS gates,
  CASE WHEN tech_score + content_score >= 30 THEN '개선 여지 큼' ELSE '초기 단계' END AS band FROM audited""")
def audit(spark, sf):
    a = audit_plan.audit(page_table(spark, sf))
    return a.select(
        "page_id", *[F.col(c).cast("bigint").alias(c) for c in ("tech_score", "content_score", "score")], "needs_render",
        F.array_join("band_gates", ",").alias("gates"), "band",
    )


@query("batch_audit", f"""WITH {AUDIT}
SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL ELSE tech_score + content_score END AS score,
  CASE WHEN page_id % 9 = 0 THEN 'bad-scheme' END AS error FROM audited""")
def batch_audit(spark, sf):
    p = page_table(spark, sf)
    u = F.when(F.col("page_id") % 9 == 0, F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    rows = audit_plan.batch_audit(p.withColumn("url", u))
    return rows.select("page_id", F.col("score").cast("bigint").alias("score"), "error")


@query("llms_txt", """
SELECT page_id, max(page_id % 10 = 0) OVER (PARTITION BY lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))) AS has_llms_txt FROM pages""")
def llms_txt(spark, sf):
    from ..sources.readers import with_host

    hosted = with_host(page_table(spark, sf))
    files = hosted.select("host", F.when(F.col("page_id") % 10 == 0, 200).otherwise(404).alias("status"))
    return signals.with_llms_txt(hosted, files).select("page_id", "has_llms_txt")


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


def _site_files(spark, sf):
    """robots.txt and llms.txt answers per host: which rules a host has depends on the length of its name."""
    from ..sources.readers import with_host

    hosts = with_host(page_table(spark, sf)).select("host").distinct()
    kind = F.length("host") % 4
    body = F.element_at(
        F.array(*[F.lit(b) for b in ("", "User-agent: *\nDisallow: /\n", "User-agent: Googlebot\nDisallow: /blog/\n", "User-agent: *\nAllow: /\n")]), kind + 1
    )
    robots = hosts.select("host", F.when(kind == 0, 404).otherwise(200).alias("status"), F.lit("text/plain").alias("content_type"), body.alias("body"))
    return robots, hosts.select("host", F.when(F.length("host") % 2 == 0, 200).otherwise(404).alias("status"))


@query("audit_full", f"""WITH {AUDIT}, c AS (
  SELECT *, CASE length({_HOST}) % 4 WHEN 0 THEN 11 WHEN 1 THEN 2 WHEN 2 THEN 9 ELSE 15 END AS crawl FROM audited)
SELECT page_id, crawl, length({_HOST}) % 2 = 0 AS has_llms_txt, page_id % 3 = 2 AS embeddable, CASE WHEN render THEN 'measurement-limited' ELSE 'no-form' END AS readiness,
  tech_score - 11 + crawl + content_score AS score, crawl = 2 AS blocked, 'v0.4' AS methodology_version, length(c.url) > 0 AS torn FROM c""")
def audit_full(spark, sf):
    n = F.col("page_id") % 3
    headers = F.when(n == 0, F.create_map(F.lit("X-Frame-Options"), F.lit("DENY"))).when(
        n == 1, F.create_map(F.lit("Content-Security-Policy"), F.lit("frame-ancestors 'self'"))
    ).otherwise(F.create_map(F.lit("Server"), F.lit("x")))
    robots, llms = _site_files(spark, sf)
    a = audit_plan.audit_full(page_table(spark, sf).withColumn("headers", headers), robots, llms)
    crawl = F.get(F.filter("items", lambda i: i["key"] == "crawl"), F.lit(0))["points"]
    return a.select(
        "page_id", crawl.alias("crawl"), "has_llms_txt", "embeddable", F.col("readiness.status").alias("readiness"),
        F.col("score").cast("bigint").alias("score"), F.array_contains("band_gates", "crawl-blocked").alias("blocked"), "methodology_version",
        (F.length("teardown.title") > 0).alias("torn"),
    )


@query("batch_audit_history", f"""WITH {AUDIT}, d AS (SELECT *, regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, tech_score + content_score AS score FROM audited),
h AS (SELECT domain, arg_max(page_id % 50, page_id) AS prev_score FROM d GROUP BY domain)
SELECT page_id, domain, score, prev_score, score - prev_score AS delta FROM d LEFT JOIN h USING (domain)""")
def batch_audit_history(spark, sf):
    from ..functions.urls import registrable_domain

    p = page_table(spark, sf)
    earlier = p.select(
        registrable_domain("url").alias("domain"), F.timestamp_seconds("page_id").alias("ts"), (F.col("page_id") % 50).alias("score"), F.lit("b").alias("band")
    )
    rows = audit_plan.batch_audit(p, history=earlier, now=F.lit("2026-01-01").cast("timestamp"))
    return rows.select("page_id", "domain", F.col("score").cast("bigint").alias("score"), "prev_score", F.col("delta").cast("bigint").alias("delta"))
