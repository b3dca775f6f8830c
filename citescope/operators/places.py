"""Place listings: counts, brand names, entity match, ranks, gaps.

Name matching never pairs all listings of a query with all sites. "Contains" becomes equality on
substrings, and only the best-placed listing per (query, text) survives before the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ordered import top_k
from ..functions.stats import one_decimal, ratio
from ..functions.text import WS, col, no_nulls, strip, text_or_empty
from ..functions.urls import loose_host_match


def parse_count(value: Column | str) -> Column:
    """K1: "2,203" -> 2203; a leading number counts, anything else is NULL."""
    digits = F.regexp_extract(F.regexp_replace(col(value).cast("string"), ",", ""), rf"^{WS}*([+-]?\d+)", 1)
    return digits.try_cast("bigint")


def normalize_places(places: DataFrame) -> DataFrame:
    """K2: typed listing rows; other columns (query, rank) stay."""
    raw = {"id", "name", "category", "address", "roadAddress", "phone", "x", "y", "visitorReviewCount",
           "blogCafeReviewCount", "bookingReviewCount", "imageCount", "businessHours"}
    filled = lambda c: F.when(text_or_empty(c) != "", F.col(c))
    has_xy = (text_or_empty("x") != "") & (text_or_empty("y") != "")
    return places.select(
        *[c for c in places.columns if c not in raw],
        F.col("id").alias("place_id"), F.concat(F.lit(K.PLACE_URL), F.col("id")).alias("map_url"), "name",
        filled("category").alias("category"), filled("address").alias("address"),
        filled("roadAddress").alias("road_address"), filled("phone").alias("phone"),
        F.when(
            has_xy,
            F.struct(F.col("x").try_cast("double").alias("lng"), F.col("y").try_cast("double").alias("lat")),
        ).alias("coords"),
        parse_count("visitorReviewCount").alias("visitor_reviews"),
        parse_count("blogCafeReviewCount").alias("blog_reviews"),
        parse_count("bookingReviewCount").alias("booking_reviews"),
        F.col("imageCount").try_cast("bigint").alias("photos"), filled("businessHours").alias("business_hours"),
    )


def core_name(name: Column | str) -> Column:
    """K3: brand part of a name: no blanks, institution words stripped from the end.

    A name that would be left with less than two characters is kept whole.
    """
    flat = F.regexp_replace(F.lower(strip(text_or_empty(name))), WS + "+", "")
    core = F.regexp_replace(flat, f"(?:{K.PLACE_SUFFIXES})+$", "")
    return F.when(F.length(core) >= 2, core).otherwise(flat)


def _digits(phone: Column) -> Column:
    return F.regexp_replace(text_or_empty(phone), r"\D", "")


def _substrings(text: Column, sizes: Column) -> Column:
    """Distinct substrings of the given sizes: at most length x sizes, sizes longer than the text give none."""
    fitting = F.filter(sizes, lambda n: n <= F.length(text))
    pieces = F.transform(
        fitting,
        lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda s: F.substring(text, s, n)),
    )
    return F.array_distinct(F.flatten(pieces))


def match_target(
    places: DataFrame, sites: DataFrame, query: Sequence[str] = ("query",), site: str = "site",
    place_id: str = "place_id", carry: Sequence[str] = (),
) -> DataFrame:
    """K4: the listing of each site in its query, by tier: phone, last seven digits, name, name part.

    `places`: query, rank, place_id, name, phone. `sites`: query, site, phone, name. Inside a tier
    the first listing wins. Sites without a match are absent. `carry` names further columns of `places` to return.

    Every listing and site is turned into (tier, key) rows once; equal rows meet in one join. "Contains" is equality
    on substrings, and only of the lengths that the other side's names have in this query.
    """
    query = list(query)
    listing = F.struct(
        F.col("rank").alias("rank"), F.col(place_id).alias(place_id), F.col("name").alias("place_name"), *[F.col(c).alias(c) for c in carry]
    )

    def shaped(df: DataFrame, *own: Column | str) -> DataFrame:
        return df.select(*query, *own, _digits(F.col("phone")).alias("_phone"), core_name("name").alias("_core"))

    rows, wanted = shaped(places, listing.alias("_place")), shaped(sites, site)

    def sizes(df: DataFrame, out: str) -> DataFrame:
        long = F.when(F.length("_core") >= 2, F.length("_core"))
        return df.groupBy(*query).agg(F.collect_set(long).alias(out))

    lengths = sizes(rows, "_places").join(sizes(wanted, "_sites"), query)
    named = F.length("_core") >= 2

    def keys(*tiers: tuple[int, Column, Column]) -> Column:
        """array<struct<tier, key>>: (tier, condition, array of keys) in turn."""
        none = F.array().cast("array<struct<tier:int,key:string>>")

        def tagged(number: int, of: Column) -> Column:
            return F.transform(of, lambda k: F.struct(F.lit(number).alias("tier"), k.alias("key")))

        return F.concat(*[F.when(when, tagged(number, of)).otherwise(none) for number, when, of in tiers])

    phone, last7, core = F.array("_phone"), F.array(F.substring("_phone", -7, 7)), F.array("_core")
    dialled = F.length("_phone") >= 7
    # 4: the listing's name holds the site's; 5: the site's name holds the listing's. Both are the same tier.
    offered = keys(
        (1, F.col("_phone") != "", phone), (2, dialled, last7), (3, named, core), (4, named, _substrings(F.col("_core"), F.col("_sites"))), (5, named, core)
    )
    asked = keys((1, dialled, phone), (2, dialled, last7), (3, named, core), (4, named, core), (5, named, _substrings(F.col("_core"), F.col("_places"))))
    left = rows.join(lengths.drop("_places"), query).select(*query, "_place", F.explode(offered).alias("_k"))
    best = left.groupBy(*query, "_k").agg(F.min("_place").alias("_place"))
    right = wanted.join(lengths.drop("_sites"), query).select(*query, site, F.explode(asked).alias("_k"))
    hits = right.join(best, [*query, "_k"])
    tier = F.least(F.col("_k.tier"), F.lit(4))
    chosen = hits.groupBy(*query, site).agg(F.min(F.struct(tier.alias("tier"), "_place")).alias("_hit"))
    return chosen.select(
        *query, site, F.col("_hit.tier").alias("tier"), F.col("_hit._place.rank").alias("target_rank"),
        F.col(f"_hit._place.{place_id}").alias(place_id), F.col("_hit._place.place_name").alias("place_name"),
        *[F.col(f"_hit._place.{c}").alias(c) for c in carry],
    )


def place_rank(
    places: DataFrame, matches: DataFrame, query: Sequence[str] = ("query",), site: str = "site",
    place_id: str = "place_id", others: int = 5, sites: DataFrame | None = None,
) -> DataFrame:
    """K5: the best-placed other listings of each site.

    Six listings per query are enough to leave one out and keep five, so every query is cut to
    these before sites meet them. Pass `sites` to include unmatched ones.
    """
    query = list(query)
    order = [F.col("rank").asc(), F.col(place_id).asc()]
    head = top_k(places, query, order, others + 1, "_r").drop("_r")
    asked = sites.select(*query, site) if sites is not None else None
    target = matches.select(*query, site, F.col(place_id).alias("_target"), "target_rank")
    who = asked.join(target, [*query, site], "left") if sites is not None else target
    rivals = who.join(head, query).where(F.col("_target").isNull() | (F.col(place_id) != F.col("_target")))
    return top_k(rivals, [*query, site], order, others, "competitor_no").drop("_target")


def first_rivals(
    places: DataFrame, matches: DataFrame, sites: DataFrame, counts: Sequence[str], query: Sequence[str] = ("query",),
    site: str = "site", place_id: str = "place_id",
) -> DataFrame:
    """K7 input: every site with `matched`, its own listing's counts and those of the best-placed other listing as top_*.

    `matches` carries the counts of the own listing. The first two listings per query are enough to leave one out;
    they are gathered in one row per query, so sites meet one row each.
    """
    query = list(query)
    entry = F.struct(F.col("rank").alias("rank"), F.col(place_id).alias("id"), *[F.col(c).alias(c) for c in counts])
    head = top_k(places, query, [F.col("rank").asc(), F.col(place_id).asc()], 2, "_r")
    pair = head.groupBy(*query).agg(F.array_sort(F.collect_list(entry)).alias("_head"))
    own = matches.select(*query, site, F.col(place_id).alias("_own"), *counts)
    joined = sites.select(*query, site).join(own, [*query, site], "left").join(pair, query, "left")
    rival = F.get(F.filter("_head", lambda e: F.col("_own").isNull() | (e["id"] != F.col("_own"))), F.lit(0))
    return joined.select(
        *query, site, F.col("_own").isNotNull().alias("matched"), *counts, *[rival[c].alias(f"top_{c}") for c in counts]
    )


def local_rank(items: DataFrame, sites: DataFrame, query: Sequence[str] = ("query",), site: str = "site") -> DataFrame:
    """K6: first of the five local results whose link belongs to the site."""
    query = list(query)
    title = strip(F.regexp_replace(F.col("title"), "<[^>]+>", ""))
    head = items.where(F.col("rank") <= K.LOCAL_TOP).withColumn("_name", title)
    joined = sites.select(*query, site).join(head, query, "left")
    hit = loose_host_match("link", site)
    found = joined.groupBy(*query, site).agg(
        F.count("rank").alias("total_items"),
        F.min(F.when(hit, F.struct(F.col("rank").alias("rank"), F.col("_name").alias("name")))).alias("_hit"),
    )
    return found.select(
        *query, site, "total_items", F.col("_hit").isNotNull().alias("cited"),
        F.col("_hit.rank").alias("local_rank"), F.col("_hit.name").alias("name"),
    )


def review_gap(mine: Column, theirs: Column) -> Column:
    """K7: text for one kind of reviews against the best-placed rival."""
    m, t = F.coalesce(mine, F.lit(0)), F.coalesce(theirs, F.lit(0))
    return (
        F.when((t > m) & (m > 0), F.format_string(K.GAP_RATIO_TEXT, one_decimal(ratio(t, m))))
        .when(t > m, K.GAP_LARGE_TEXT)
        .otherwise(K.GAP_AHEAD_TEXT)
    )


def place_gaps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K7: flags, ratio texts and the gap rows.

    `rows`: keys, matched BOOLEAN, booking_reviews, visitor_reviews, blog_reviews and the same of the
    first rival as top_visitor_reviews, top_blog_reviews (NULL without a rival).
    """
    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    matched = F.coalesce(F.col("matched"), F.lit(False))
    rival = F.col("top_visitor_reviews").isNotNull() | F.col("top_blog_reviews").isNotNull()
    booking_ok = matched & (number("booking_reviews") > 0)
    big = matched & rival & (
        (number("top_visitor_reviews") >= number("visitor_reviews") * 2)
        | (number("top_blog_reviews") >= number("blog_reviews") * 2)
    )
    tests = {
        "booking-missing": matched & ~booking_ok, "place-unmatched": ~matched, "owned-content": F.lit(True),
        "clip-video": F.lit(True), "review-gap": big, "monthly-watch": F.lit(True),
    }
    gaps = no_nulls(
        *[
            F.when(
                tests[code],
                F.struct(F.lit(code).alias("code"), F.lit(gap).alias("gap"), F.lit(action).alias("action")),
            )
            for code, gap, action in K.PLACE_GAPS
        ]
    )
    both = matched & rival
    return rows.select(
        *keys, booking_ok.alias("booking_ok"), big.alias("review_gap_big"),
        F.when(both, review_gap(F.col("visitor_reviews"), F.col("top_visitor_reviews"))).alias("visitor_gap"),
        F.when(both, review_gap(F.col("blog_reviews"), F.col("top_blog_reviews"))).alias("blog_gap"),
        gaps.alias("gaps"),
    )

