"""Page signals: column expressions over the shredded page. Page-local, so nothing shuffles.

`page_signals` works in three projections: the shredded page, the element lists several rules
share, and the signals. `html` and the element arrays are left behind there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import (
    WS, col, count_matches, first_or_null, host_in, let, one_of, squeeze, strip, text_or_empty,
    unicode_space,
)
from ..functions.urls import domain_of_host
from .shred import (
    BELOW_CHROME, BELOW_FORM, BELOW_SOURCE_BOX, BELOW_SOURCE_TAG, IN_REVIEW, IN_SUP, LABELLED, REFERRED, shred_pages,
)

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

# Syllables that end in the consonant n: every 28th from the fifth on.
N_FINAL = "".join(chr(c) for c in range(0xAC00, 0xD7A4) if (c - 0xAC00) % 28 == 4)


# --- patterns assembled from the fixed values -------------------------------------------------

def address_pattern() -> str:
    return unicode_space(rf"{_sido()}(?:\s*{K.DISTRICT}){{0,2}}\s*{K.ROAD}\s*\d")


def full_address_pattern() -> str:
    return unicode_space(
        rf"{_sido()}(?:(?:\s*{K.DISTRICT}){{1,2}}(?:\s*{K.ROAD})?|\s*{K.ROAD}\s*\d)"
    )


def _sido() -> str:
    """Any province spelling, the longest first."""
    return one_of(sorted((name for name, _ in K.SIDO), key=len, reverse=True))


def question_pattern() -> str:
    tail = r"(?:\s*[(\[（][^)\]）]{0,12}[)\]）])?[\s.!·…\"'”’)\]]*\z"
    endings = "|".join([f"{K.QUESTION_NOT_BEFORE}[{N_FINAL}][가지]", *K.QUESTION_ENDINGS])
    why = r"(?:^|[\s(“'\"])왜(?=[\s?？]|\z)"
    return unicode_space(f"{K.QUESTION_MARKS}|{K.QUESTION_HOW}|{why}|(?:{endings}){tail}")


STATISTIC = unicode_space(K.STATISTIC)
SOURCE_INLINE = unicode_space("(?=[가-힣RrBbSs])(?:" + K.SOURCE_INLINE + ")")
PRICE_ITEM = one_of(K.PRICE_ITEM.split("|"))
CREDENTIALS = one_of(K.CREDENTIAL_TERMS.split("|"))


# --- element access ---------------------------------------------------------------------------

def attr(node: Column, name: str) -> Column:
    return text_or_empty(node["attrs"][name])


def has_attr(node: Column, name: str) -> Column:
    return node["attrs"][name].isNotNull()


def has_class(node: Column, *names: str) -> Column:
    tokens = F.split(node["attrs"]["class"], WS + "+")
    return has_attr(node, "class") & F.arrays_overlap(tokens, F.array(*[F.lit(n) for n in names]))


def flagged(node: Column, bits: int) -> Column:
    """Any of these bits is set in the flags of the element (see `shred`)."""
    return node["flags"].bitwiseAND(F.lit(bits)) > 0


def with_tag(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(list(tags)))


def texts(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: text_or_empty(n["text"]))


# --- text-only signals, usable without the tree -----------------------------------------------

def script_count(html: Column | str) -> Column:
    return count_matches(html, r"(?i)<script\b")


def text_ratio(visible_len: Column, html: Column | str) -> Column:
    size = F.length(col(html))
    return F.when(size > 0, F.round(visible_len / size, 3)).otherwise(F.lit(0.0))


def credential_hits(text: Column | str, terms: str = CREDENTIALS) -> Column:
    return count_matches(text, terms)


def phone_in(text: Column | str) -> Column:
    return col(text).rlike(unicode_space(K.PHONE))


def address_in(text: Column | str) -> Column:
    return col(text).rlike(address_pattern())


def is_question(text: Column | str) -> Column:
    return col(text).rlike(question_pattern())


def answer_first(text: Column | str) -> Column:
    """A particle between two ASCII word characters in the first 240 characters, if there are more than 80.

    Word borders are those of ASCII words; plain Korean text has none beside a particle. Informational: no score reads it.
    """
    start = F.substring(text_or_empty(text), 1, 240)
    return (F.length(start) > 80) & start.rlike(K.ANSWER_PARTICLE)


def has_map_embed(html: Column | str) -> Column:
    return col(html).rlike(K.MAP_EMBED)


def name_guess(title: Column, og_title: Column | None = None) -> Column:
    """First segment of the title: most sites put their name there."""
    source = F.when(title != "", title)
    source = F.coalesce(source, og_title, F.lit("")) if og_title is not None else F.coalesce(source, F.lit(""))
    return F.substring(strip(F.get(F.split(source, K.NAME_SPLIT), F.lit(0))), 1, 40)


def plain_text(html: Column | str) -> Column:
    """Text of a page by patterns alone, tags replaced by blanks."""
    text = F.regexp_replace(col(html), r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    return squeeze(F.regexp_replace(text, r"<[^>]+>", " "))


def title_by_pattern(html: Column | str) -> Column:
    return squeeze(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def teardown(
    html: Column | str, metas: int = 12, blocks: int = 5, block_chars: int = 1400,
    text_chars: int = 900,
) -> Column:
    """Head of a page for side-by-side reading: title, metas, JSON-LD blocks, leading text."""
    source = col(html)
    tags = F.regexp_extract_all(source, F.lit(r"(?i)(<meta\s[^>]+>)"), F.lit(1))
    kept = F.filter(
        tags,
        lambda t: t.rlike(
            r"""(?i)name=["'](?:description|keywords|robots|author)|property=["'](?:og:|twitter:)"""
        ),
    )
    ld = F.regexp_extract_all(
        source,
        F.lit(r"""(?is)<script[^>]+type=['"]application/ld\+json['"][^>]*>(.*?)</script>"""),
        F.lit(1),
    )
    return F.struct(
        F.substring(title_by_pattern(source), 1, 200).alias("title"),
        F.transform(F.slice(kept, 1, metas), lambda t: F.substring(squeeze(t), 1, 300)).alias("metas"),
        F.transform(
            F.slice(ld, 1, blocks), lambda t: F.substring(strip(t), 1, block_chars)
        ).alias("jsonlds"),
        F.substring(plain_text(source), 1, text_chars).alias("body_text"),
    )


def procedure_hits(
    text: Column | str, procedures: Sequence[tuple[str, str, Sequence[str]]] = K.PROCEDURES
) -> Column:
    """array<struct<q, label, hits>> of procedures with hits, most frequent first, then in order."""
    def count(source: Column, word: str) -> Column:
        gone = F.length(source) - F.length(F.replace(source, F.lit(word.lower()), F.lit("")))
        return (gone / len(word)).cast("int")

    def ranked(source: Column) -> Column:
        rows = []
        for position, (query, label, words) in enumerate(procedures):
            hits = count(source, words[0])
            for word in words[1:]:
                hits = hits + count(source, word)
            rows.append(
                F.struct(hits.alias("hits"), F.lit(position).alias("position"), F.lit(query).alias("q"), F.lit(label).alias("label"))
            )
        hit = F.filter(F.array(*rows), lambda r: r["hits"] > 0)
        found = F.array_sort(
            F.transform(
                hit,
                lambda r: F.struct(
                    (-r["hits"]).alias("rank"), r["position"].alias("position"), r["q"].alias("q"), r["label"].alias("label"),
                    r["hits"].alias("hits"),
                ),
            )
        )
        return F.transform(
            found, lambda r: F.struct(r["q"].alias("q"), r["label"].alias("label"), r["hits"].alias("hits"))
        )

    # One look for any keyword spares most pages the count of each.
    every = one_of([w.lower() for _, _, words in procedures for w in words])
    none = F.array().cast("array<struct<q:string,label:string,hits:int>>")
    return let(F.lower(col(text)), lambda low: F.when(low.rlike(every), ranked(low)).otherwise(none))


# --- JSON-LD ----------------------------------------------------------------------------------

def jsonld_profile(ld: Column) -> Column:
    """What the JSON-LD objects of a page say, first occurrence first."""
    def of(o: Column, pattern: str) -> Column:
        return F.coalesce(F.exists(o["types"], lambda t: t.rlike(pattern)), F.lit(False))

    typed = F.filter(ld, lambda o: o["types"].isNotNull())
    shared = F.struct(
        F.array_distinct(F.flatten(F.transform(typed, lambda o: o["types"]))).alias("types"),
        F.size(typed).alias("count"),
        F.filter(ld, lambda o: of(o, K.DENTAL_TYPE) | of(o, "(?i)Organization|LocalBusiness")).alias("organisations"),
        F.flatten(F.transform(ld, lambda o: o["same_as"])).alias("same_as"),
    )
    return let(shared, lambda s: _profile_struct(ld, s["types"], s["count"], s["organisations"], s["same_as"]))


def _profile_struct(ld: Column, types: Column, count: Column, organisations: Column, same_as: Column) -> Column:
    def any_type(pattern: str) -> Column:
        return F.exists(types, lambda t: t.rlike(pattern))

    def of_type(o: Column, pattern: str) -> Column:
        return F.coalesce(F.exists(o["types"], lambda t: t.rlike(pattern)), F.lit(False))

    def with_key(*names: str) -> Column:
        return F.exists(
            ld,
            lambda o: F.arrays_overlap(o["truthy"], F.array(*[F.lit(n) for n in names])),
        )

    def entity(*names: str) -> Column:
        return F.exists(
            organisations,
            lambda o: F.arrays_overlap(o["truthy"], F.array(*[F.lit(n) for n in names])),
        )

    def scalar(o: Column, *names: str) -> Column:
        return F.coalesce(*[o["scalars"][n] for n in names])

    ratings = F.filter(
        F.transform(
            ld,
            lambda o: F.when(
                F.array_contains(o["truthy"], "aggregateRating"),
                F.struct(
                    scalar(o, "aggregateRating.ratingValue", "aggregateRating.ratingvalue").alias("value"),
                    scalar(
                        o, "aggregateRating.ratingCount", "aggregateRating.reviewCount",
                        "aggregateRating.ratingcount", "aggregateRating.reviewcount",
                    ).alias("count"),
                ),
            ).when(
                of_type(o, "(?i)AggregateRating"),
                F.struct(
                    scalar(o, "ratingValue", "ratingvalue").alias("value"),
                    scalar(o, "ratingCount", "reviewCount", "ratingcount", "reviewcount").alias("count"),
                ),
            ),
        ),
        lambda r: r["value"].isNotNull() | r["count"].isNotNull(),
    )
    rating = first_or_null(ratings)
    parts = first_or_null(
        F.filter(
            F.transform(
                ld,
                lambda o: F.struct(
                    strip(text_or_empty(o["scalars"]["address.addressRegion"])).alias("region"),
                    strip(text_or_empty(o["scalars"]["address.addressLocality"])).alias("locality"),
                    strip(text_or_empty(o["scalars"]["address.streetAddress"])).alias("street"),
                ),
            ),
            lambda a: (a["region"] != "") | (a["locality"] != "") | (a["street"] != ""),
        )
    )
    address_text = first_or_null(
        F.filter(F.transform(ld, lambda o: strip(text_or_empty(o["scalars"]["address"]))), lambda a: a != "")
    )
    return F.struct(
        types.alias("types"),
        count.alias("count"),
        with_key("datePublished", "dateModified").alias("has_date"),
        with_key("telephone").alias("has_telephone"),
        with_key("address").alias("has_address"),
        parts.alias("address_parts"),
        text_or_empty(address_text).alias("address_raw"),
        any_type(K.DENTAL_TYPE).alias("has_dental"),
        any_type("(?i)FAQPage").alias("has_faq"),
        any_type(K.TRUST_TYPE).alias("has_trust"),
        F.exists(same_as, lambda u: u.rlike(K.SAME_AS_AUTHORITY)).alias("has_same_as_authority"),
        (any_type("(?i)AggregateRating") | rating.isNotNull()).alias("has_aggregate_rating"),
        any_type("(?i)MedicalWebPage").alias("has_medical_page"),
        any_type("(?i)BreadcrumbList").alias("has_breadcrumb"),
        F.size(F.filter(ld, lambda o: of_type(o, "(?i)^Question$"))).alias("faq_count"),
        F.struct(
            F.substring(rating["value"], 1, 8).alias("value"),
            rating["count"].try_cast("double").alias("count"),
        ).alias("rating"),
        F.slice(F.array_distinct(F.transform(same_as, lambda u: strip(u))), 1, 12).alias("same_as"),
        F.struct(
            entity("name").alias("name"),
            entity("telephone").alias("telephone"),
            entity("address").alias("address"),
            entity("openingHours", "openingHoursSpecification").alias("openingHours"),
            entity("geo").alias("geo"),
            entity("sameAs").alias("sameAs"),
            entity("priceRange").alias("priceRange"),
            entity("areaServed").alias("areaServed"),
            entity("medicalSpecialty", "availableService", "knowsAbout").alias("medicalSpecialty"),
        ).alias("entity"),
    )


# --- reviews, sources, quotes -----------------------------------------------------------------

def is_review(n: Column, nodes: Column) -> Column:
    """The element belongs to patient reviews: by its box, its cite text or the heading before it."""
    quoted = F.when(n["tag"] == "cite", n["text"]).otherwise(F.get(nodes, n["cite"])["text"])
    cite = F.coalesce(F.when(text_or_empty(quoted) != "", quoted), attr(n, "cite"))
    by_cite = squeeze(cite).rlike(unicode_space(K.REVIEW_CITE))
    by_heading = text_or_empty(F.get(nodes, n["head"])["text"]).rlike(unicode_space(K.REVIEW_HEADING))
    return flagged(n, IN_REVIEW) | F.coalesce(by_cite, F.lit(False)) | by_heading


_JUDGED = ["p", "li", "td", "dd", "blockquote", "figcaption", "h2", "h3", "cite", "a"]


def prose_nodes(nodes: Column) -> Column:
    """Elements that may carry evidence, patient reviews left out."""
    candidates = F.filter(
        nodes, lambda n: n["tag"].isin(_JUDGED) | has_class(n, "reference", "citation")
    )

    def judged(found: Column) -> Column:
        # Most pages hold no review box, cite or review heading: then every element stays.
        suspicious = F.exists(found, lambda n: flagged(n, IN_REVIEW) | has_attr(n, "cite")) | F.exists(
            nodes,
            lambda n: (n["tag"] == "cite") | (n["tag"].isin(HEADINGS) & text_or_empty(n["text"]).rlike(unicode_space(K.REVIEW_HEADING))),
        )
        return F.when(suspicious, F.filter(found, lambda n: ~is_review(n, nodes))).otherwise(found)

    return let(candidates, judged)


def link_host(href: Column) -> Column:
    """Host of an absolute http(s) link without port and www., '' otherwise."""
    host = F.lower(F.regexp_extract(strip(href), r"(?i)^https?://([^/?#]+)", 1))
    return F.regexp_replace(F.regexp_replace(host, r":\d+$", ""), r"^www\.", "")


def source_links(prose: Column, own_domain: Column) -> Column:
    """array<struct<host, domain, authority>> of links that can count as sources."""
    links = F.filter(
        prose,
        lambda n: (n["tag"] == "a") & has_attr(n, "href") & ~flagged(n, BELOW_CHROME)
        & flagged(n, BELOW_SOURCE_TAG | BELOW_SOURCE_BOX),
    )
    hosts = F.filter(F.transform(links, lambda n: link_host(attr(n, "href"))), lambda h: h != "")
    found = F.transform(
        hosts,
        lambda h: F.struct(
            h.alias("host"), domain_of_host(h).alias("domain"),
            host_in(h, K.AUTHORITY_HOSTS).alias("authority"),
        ),
    )
    return F.filter(
        found,
        lambda s: ((own_domain == "") | (s["domain"] != own_domain))
        & ~host_in(s["host"], K.NON_SOURCE_HOSTS),
    )


def section_profile(nodes: Column) -> Column:
    """Share of h2 sections with 250 to 900 characters, NULL without h2."""
    lengths = F.transform(with_tag(nodes, "h2"), lambda h: F.length(squeeze(h["section"])))
    return let(
        lengths,
        lambda ls: F.when(
            F.size(ls) > 0,
            F.round(F.size(F.filter(ls, lambda x: x.between(250, 900))) / F.size(ls), 2),
        ),
    )


# --- forms ------------------------------------------------------------------------------------

def _first_per_key(items: Column, key: str, wins: str) -> Column:
    """Mark the first item of every non-empty key: sort by (key, id) and look one back."""
    ordered = F.array_sort(
        F.transform(
            items, lambda x: F.struct(x[key].alias("k"), x["id"].alias("id"), x.alias("item"))
        )
    )
    return let(
        ordered,
        lambda o: F.transform(
            o,
            lambda x, i: x["item"].withField(
                wins,
                x["k"].isNotNull()
                & ((i == 0) | ~F.get(o, i - 1)["k"].eqNullSafe(x["k"])),
            ),
        ),
    )


def form_accessibility(nodes: Column) -> Column:
    """Can a machine name the controls of the forms of a page? Counts and up to five samples."""
    def blank_to_null(c: Column) -> Column:
        return F.when(strip(c) != "", strip(c))

    def role(n: Column) -> Column:
        return F.lower(attr(n, "role"))

    def kind(n: Column) -> Column:
        return F.lower(attr(n, "type"))

    controls = F.filter(
        nodes,
        lambda n: flagged(n, BELOW_FORM)
        & (
            ((n["tag"] == "input") & (attr(n, "type") != "hidden"))
            | n["tag"].isin("select", "textarea", "button")
            | (role(n) == "button")
        )
        & (kind(n) != "reset"),
    )

    def describe(n: Column) -> Column:
        return (
            F.when(
                n["tag"] == "input",
                F.when(kind(n) != "", F.concat(F.lit('<input type="'), kind(n), F.lit('">'))).otherwise("<input>"),
            )
            .when(
                (role(n) == "button") & (n["tag"] != "button"),
                F.concat(F.lit("<"), n["tag"], F.lit(' role="button">')),
            )
            .otherwise(F.concat(F.lit("<"), n["tag"], F.lit(">")))
        )

    def facts(found: Column) -> Column:
        def one(n: Column) -> Column:
            spoken = strip(attr(n, "aria-label")) != ""
            aria = spoken | flagged(n, REFERRED)
            is_button = (n["tag"] == "button") | (role(n) == "button")
            by_button = (
                (is_button & (n["filled"] | (strip(attr(n, "value")) != "")))
                | (
                    (n["tag"] == "input") & kind(n).isin("submit", "button", "image")
                    & ((strip(attr(n, "value")) != "") | (strip(attr(n, "alt")) != ""))
                )
            )
            return F.struct(
                n["id"].alias("id"),
                aria.alias("aria"),
                F.when(~aria & flagged(n, LABELLED), blank_to_null(attr(n, "id"))).alias("for_key"),
                n["wrap"].alias("wrap"),
                by_button.alias("by_button"),
                ((strip(attr(n, "placeholder")) != "") | (strip(attr(n, "title")) != "")).alias("weak"),
                (
                    (kind(n) == "submit")
                    | ((n["tag"] == "button") & kind(n).isin("", "submit"))
                    | ((n["tag"] == "input") & (kind(n) == "image"))
                    | (role(n) == "button")
                ).alias("submit"),
                describe(n).alias("shape"),
                F.lit(None).cast("int").alias("wrap_key"),
            )

        return F.transform(found, one)

    base = let(controls, facts)
    by_label = _first_per_key(base, "for_key", "by_for")
    waiting = F.transform(
        by_label,
        lambda c: c.withField("wrap_key", F.when(~c["aria"] & ~c["by_for"], c["wrap"])),
    )
    by_wrap = _first_per_key(waiting, "wrap_key", "by_wrap")
    judged = F.array_sort(
        F.transform(
            by_wrap,
            lambda c: F.struct(
                c["id"].alias("id"),
                (c["aria"] | c["by_for"] | c["by_wrap"] | c["by_button"]).alias("strong"),
                c["weak"].alias("weak"), c["submit"].alias("submit"), c["shape"].alias("shape"),
            ),
        )
    )
    forms = with_tag(nodes, "form")
    booking = F.filter(
        forms,
        lambda n: F.concat_ws(
            " ", attr(n, "action"), attr(n, "id"), attr(n, "class"), attr(n, "name")
        ).rlike(K.BOOKING)
        | F.substring(text_or_empty(n["text"]), 1, 400).rlike(K.BOOKING),
    )

    def report(c: Column) -> Column:
        named = F.filter(c, lambda x: x["strong"] | x["weak"])
        submits = F.filter(c, lambda x: x["submit"])
        unnamed = F.filter(c, lambda x: ~x["strong"] & ~x["weak"])
        return F.struct(
            F.size(forms).alias("forms"),
            F.size(booking).alias("booking_forms"),
            F.size(c).alias("controls_total"),
            F.size(named).alias("controls_named"),
            F.size(F.filter(c, lambda x: ~x["strong"] & x["weak"])).alias("placeholder_only"),
            F.size(submits).alias("submit_total"),
            F.size(F.filter(submits, lambda x: x["strong"] | x["weak"])).alias("submit_named"),
            F.slice(F.transform(unnamed, lambda x: x["shape"]), 1, 5).alias("unnamed_samples"),
        )

    return let(judged, report)


# --- location ---------------------------------------------------------------------------------

def sido_short(name: Column) -> Column:
    """Short spelling of a province; unknown spellings lose their suffix."""
    known = F.create_map(*[F.lit(x) for pair in K.SIDO for x in pair])
    text = strip(name)
    cut = F.nullif(strip(F.regexp_replace(text, K.SIDO_TAIL, "")), F.lit(""))
    return F.coalesce(known[text], cut, text)


def colloquial_district(district: Column) -> Column:
    """How people search: without suffix, unless less than two characters would be left."""
    base = F.regexp_replace(district, "(?:시|군|구)$", "")
    return F.when(F.length(base) >= 2, base).otherwise(district)


def location_guess(text: Column, profile: Column) -> Column:
    """struct<raw, sido, district, dong, region> from JSON-LD or text, NULL if nothing is found."""
    sido = _sido()
    parts = profile["address_parts"]
    joined = F.concat_ws(
        " ", *[F.when(parts[p] != "", parts[p]) for p in ("region", "locality", "street")]
    )
    raw = F.when(parts.isNotNull(), joined).when(
        profile["address_raw"] != "", profile["address_raw"]
    ).otherwise(F.regexp_extract(text, full_address_pattern(), 0))

    known = F.create_map(*[F.lit(x) for pair in K.SIDO for x in pair])
    lead = unicode_space(rf"^\s*({sido})")

    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    def province(raw: Column) -> Column:
        long_sido = F.coalesce(
            filled(parts["region"]), filled(F.regexp_extract(raw, f"(?:^|[^가-힣])({sido})(?![가-힣])", 1)),
            F.regexp_extract(raw, lead, 1),
        )
        rest = F.regexp_replace(raw, lead, "")
        tokens = F.filter(
            F.regexp_extract_all(rest, F.lit(f"({K.DISTRICT_TOKEN})"), F.lit(1)), lambda t: ~t.rlike(K.METRO_SUFFIX)
        )
        dong = F.coalesce(
            filled(F.regexp_extract(text_or_empty(parts["street"]), K.DONG_TOKEN, 1)), F.regexp_extract(rest, K.DONG_TOKEN, 1)
        )
        return F.struct(
            strip(raw).alias("raw"), let(long_sido, sido_short).alias("sido"), tokens.alias("tokens"), dong.alias("dong")
        )

    def district(r: Column) -> Column:
        # The detected province itself is no district; a district of the same name (광주시) is.
        own = F.filter(r["tokens"], lambda t: ~F.coalesce(known[t] == r["sido"], F.lit(False)))
        gu = F.filter(r["tokens"], lambda t: t.endswith("구"))
        picked = F.coalesce(F.try_element_at(gu, F.lit(-1)), first_or_null(own), F.lit(""))
        return r.withField("district", F.coalesce(filled(parts["locality"]), picked))

    def region(r: Column) -> Column:
        area = F.coalesce(filled(colloquial_district(r["district"])), r["sido"])
        nothing = (area == "") & (r["district"] == "") & (r["dong"] == "")
        return F.when(
            ~nothing,
            F.struct(*[r[c].alias(c) for c in ("raw", "sido", "district", "dong")], area.alias("region")),
        )

    guess = let(raw, lambda t: F.when(t != "", let(let(province(t), district), region)))
    return guess


# --- the wide row -----------------------------------------------------------------------------

def _meta(nodes: Column, name: str, value: str, size: int) -> Column:
    hit = first_or_null(
        F.filter(nodes, lambda n: (n["tag"] == "meta") & (F.lower(attr(n, name)) == value))
    )
    return F.substring(squeeze(text_or_empty(hit["attrs"]["content"])), 1, size)


def page_signals(
    pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url")
) -> DataFrame:
    """One wide row of signals per page."""
    source = F.col(html)
    base = shred_pages(pages, html, "_page").select(
        *keep,
        F.col("_page"),
        script_count(source).alias("scripts"),
        F.length(source).alias("html_len"),
        has_map_embed(source).alias("has_map_embed"),
    )
    n = F.col("_page")["nodes"]
    lists = base.select(
        *keep, "scripts", "html_len", "has_map_embed",
        F.col("_page")["visible"].alias("_text"),
        F.col("_page")["shell_lens"].alias("_shells"),
        n.alias("_nodes"),
        with_tag(n, "meta", "link", "title", "base").alias("_head"),
        with_tag(n, "h1", "h2").alias("_heads"),
        prose_nodes(n).alias("_prose"),
        jsonld_profile(F.col("_page")["ld"]).alias("jsonld"),
        F.col("_page")["ld_error"].alias("ld_error"),
    )
    return _signals(lists, keep)


def _signals(lists: DataFrame, keep: Sequence[str]) -> DataFrame:
    nodes, prose, text, ld = F.col("_nodes"), F.col("_prose"), F.col("_text"), F.col("jsonld")
    head, heads = F.col("_head"), F.col("_heads")
    visible_len = F.length(text)
    h1 = F.filter(F.transform(with_tag(heads, "h1"), lambda x: strip(x["text"])), lambda t: t != "")
    h2 = F.filter(F.transform(with_tag(heads, "h2"), lambda x: strip(x["text"])), lambda t: t != "")
    dates = F.filter(
        nodes,
        lambda x: (
            (x["tag"] == "meta")
            & (
                attr(x, "property").isin("article:published_time", "article:modified_time")
                | attr(x, "itemprop").isin("datePublished", "dateModified")
            )
        )
        | ((x["tag"] == "time") & has_attr(x, "datetime")),
    )
    social = F.filter(
        nodes,
        lambda x: (x["tag"] == "a")
        & attr(x, "href").rlike("|".join(h.replace(".", r"\.") for h in K.SOCIAL_HOSTS)),
    )
    faq = F.filter(
        nodes,
        lambda x: x["tag"].isin("details", "dl") | attr(x, "itemtype").contains("FAQPage")
        | has_class(x, "faq", "qna"),
    )
    item, amount = PRICE_ITEM, unicode_space(K.PRICE_AMOUNT)
    price_lines = F.filter(
        F.transform(
            F.filter(
                nodes,
                lambda x: x["leaf"]
                & x["tag"].isin("p", "li", "td", "th", "dd", "dt", "h2", "h3", "h4", "div")
                & text_or_empty(x["text"]).rlike(item),
            ),
            lambda x: squeeze(text_or_empty(x["text"])),
        ),
        lambda t: (F.length(t) < 300) & t.rlike(amount),
    )
    price_table = F.exists(
        with_tag(nodes, "table"), lambda x: x["text"].rlike(item) & squeeze(x["text"]).rlike(amount)
    )
    stat_text = F.array_join(texts(with_tag(prose, "p", "li", "td")), " ")
    stats = F.size(
        F.array_distinct(
            F.transform(
                F.regexp_extract_all(stat_text, F.lit(f"({STATISTIC})"), F.lit(1)),
                lambda t: F.regexp_replace(t, WS + "+", ""),
            )
        )
    )
    quote_text = F.regexp_replace(
        F.array_join(
            texts(with_tag(prose, "p", "li", "td", "dd", "blockquote", "figcaption", "h2", "h3")),
            " \n ",
        ),
        r"[ \t]+", " ",
    )
    canonical_raw = attr(
        first_or_null(
            F.filter(head, lambda x: (x["tag"] == "link") & (F.lower(attr(x, "rel")) == "canonical"))
        ),
        "href",
    )
    canonical = F.substring(strip(canonical_raw), 1, 400)
    base_href = attr(
        first_or_null(F.filter(head, lambda x: (x["tag"] == "base") & has_attr(x, "href"))), "href"
    )
    own_hosts = [link_host(canonical), link_host(_meta(head, "property", "og:url", 4000)), link_host(base_href)]
    own_host = F.coalesce(*[F.when(h != "", h) for h in own_hosts], F.lit(""))
    links = let(own_host, lambda h: source_links(prose, domain_of_host(h)))
    cites = F.filter(
        prose,
        lambda x: (x["tag"] == "cite") | has_class(x, "reference", "citation")
        | ((x["tag"] == "a") & attr(x, "href").startswith("#") & flagged(x, IN_SUP)),
    )
    source_heading = F.exists(
        with_tag(nodes, *HEADINGS, "dt", "caption", "summary", "strong", "b", "legend"),
        lambda x: squeeze(x["text"]).rlike(unicode_space(K.SOURCE_LABEL)),
    )
    title = F.substring(squeeze(text_or_empty(first_or_null(with_tag(head, "title"))["text"])), 1, 300)
    notice = text.rlike(unicode_space("(?=[가-힣])(?:" + K.PRICE_NOTICE + ")"))

    first = lists.select(
        *keep, "scripts", "html_len", "has_map_embed", "jsonld", "ld_error",
        text.alias("visible_text"),
        visible_len.alias("visible_len"),
        (
            (visible_len < 500)
            | (F.exists(F.col("_shells"), lambda x: x < 80) & (visible_len < 1200))
        ).alias("needs_render"),
        F.size(h1).alias("h1_count"), F.size(h2).alias("h2_count"),
        F.slice(h1, 1, 3).alias("h1_sample"),
        (F.size(dates) + ld["has_date"].cast("int")).alias("date_signals"),
        credential_hits(text).alias("credentials"),
        F.size(social).alias("social"),
        (phone_in(text) | ld["has_telephone"]).alias("phone"),
        (address_in(text) | ld["has_address"]).alias("address"),
        F.size(F.filter(h2, is_question)).alias("question_h2"),
        F.size(with_tag(nodes, "table")).alias("tables"),
        F.size(faq).alias("faq_blocks"),
        F.size(price_lines).alias("price_item_count"),
        F.coalesce(price_table, F.lit(False)).alias("has_price_table"),
        notice.alias("has_price_notice"),
        stats.alias("stat_matches"),
        section_profile(nodes).alias("section_profile"),
        (
            (F.size(with_tag(prose, "blockquote")) > 0) | quote_text.rlike(K.QUOTED)
        ).alias("has_quotations"),
        links.alias("_links"),
        F.size(cites).alias("cite_count"),
        (text.rlike(r"\[\d+\]") | source_heading | text.rlike(SOURCE_INLINE)).alias(
            "_source_text"
        ),
        form_accessibility(nodes).alias("forms"),
        location_guess(text, ld).alias("location"),
        procedure_hits(text).alias("procedures"),
        title.alias("title"),
        _meta(head, "name", "description", 400).alias("meta_description"),
        canonical.alias("canonical"),
        _meta(head, "property", "og:title", 300).alias("og_title"),
        _meta(head, "property", "og:description", 400).alias("og_description"),
        _meta(head, "property", "og:image", 500).alias("og_image"),
        _meta(head, "name", "viewport", 200).alias("viewport"),
        _meta(head, "name", "robots", 200).alias("robots_meta"),
    )
    domains = F.size(F.array_distinct(F.transform(F.col("_links"), lambda s: s["domain"])))
    authority = F.size(F.filter(F.col("_links"), lambda s: s["authority"]))
    band = (
        F.when(F.col("has_price_table") | (F.col("price_item_count") >= 3), 2)
        .when((F.col("price_item_count") >= 1) | F.col("has_price_notice"), 1)
        .otherwise(0)
    )
    return first.select(
        *[c for c in first.columns if not c.startswith("_") and c != "html_len"],
        F.when(F.col("html_len") > 0, F.round(F.col("visible_len") / F.col("html_len"), 3))
        .otherwise(F.lit(0.0)).alias("sn"),
        F.col("jsonld.has_same_as_authority").alias("has_same_as_authority"),
        band.alias("price_band"),
        (band > 0).alias("has_price_info"),
        (F.col("stat_matches") >= 2).alias("has_statistics"),
        F.when(F.col("stat_matches") == 0, 0).when(F.col("stat_matches") <= 2, 1).otherwise(2).alias("stat_count"),
        domains.alias("source_link_count"),
        authority.alias("authority_link_count"),
        (
            (authority >= 1) | (domains >= 2) | (F.col("cite_count") > 0) | F.col("_source_text")
        ).alias("has_cited_sources"),
        name_guess(F.col("title"), F.col("og_title")).alias("name_guess"),
    )


def with_llms_txt(pages: DataFrame, files: DataFrame, host: str = "host") -> DataFrame:
    """Did the host answer /llms.txt with 200? `files`: host, status; any number per host."""
    found = files.groupBy(host).agg(F.max(F.col("status") == 200).alias("has_llms_txt"))
    return pages.join(found, host, "left").withColumn(
        "has_llms_txt", F.coalesce(F.col("has_llms_txt"), F.lit(False))
    )
