"""Site against competitor: diffs, ranked plan, follow-ups.

`pair_profiles` joins the profiles of both sides once; every diff is an array built inside that
row and exploded, so no diff joins or sorts again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import let, no_nulls, strip, text_or_empty


def pair_profiles(pairs: DataFrame, profiles: DataFrame, key: str, user: str = "user_key", comp: str = "comp_key") -> DataFrame:
    """pairs (user, comp, ...) with both profiles as structs; a missing profile is NULL."""
    body = F.struct("*")
    left = profiles.select(F.col(key).alias(user), body.alias("user"))
    right = profiles.select(F.col(key).alias(comp), body.alias("comp"))
    return pairs.join(left, user, "left").join(right, comp, "left")


def _verdict(mine: Column, theirs: Column) -> Column:
    """gap if only they have it, ahead if only we have it."""
    return F.when(~mine & theirs, "gap").when(mine & ~theirs, "ahead").otherwise("same")


def _yes(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def _item(side: str, key: str) -> Column:
    return F.get(F.filter(F.col(side)["items"], lambda x: x["key"] == key), F.lit(0))


def signal_rows() -> Column:
    """Eight items in fixed order (price is not compared). Limited on our side is no gap."""
    def row(key: str, why: str, pair: Column) -> Column:
        u, c = pair["u"], pair["c"]
        limited = F.coalesce(u["measurement"] == "limited", F.lit(False))
        u_ok = F.coalesce(u["status"] == "ok", F.lit(False))
        c_ok = F.coalesce(c["status"] == "ok", F.lit(False))
        return F.when(
            u.isNotNull() | c.isNotNull(),
            F.struct(
                F.lit(key).alias("key"),
                F.coalesce(u["label"], c["label"]).alias("label"),
                F.coalesce(u["layer"], c["layer"], F.lit("")).alias("layer"),
                F.coalesce(u["max"], c["max"], F.lit(0)).alias("weight"),
                F.when(limited, "na").otherwise(F.coalesce(u["status"], F.lit("na"))).alias("user_status"),
                F.coalesce(c["status"], F.lit("na")).alias("comp_status"),
                text_or_empty(u["note"]).alias("user_note"), text_or_empty(c["note"]).alias("comp_note"),
                u["fix"].alias("fix"),
                F.when(limited, "same").otherwise(_verdict(u_ok, c_ok)).alias("verdict"),
                F.lit(why).alias("why"),
            ),
        )

    def signal(key: str, why: str) -> Column:
        pair = F.struct(_item("user", key).alias("u"), _item("comp", key).alias("c"))
        return let(pair, lambda p: row(key, why, p))

    return no_nulls(*[signal(key, why) for key, _, _, why in K.COMPARED_SIGNALS])


def schema_rows() -> Column:
    """Nine JSON-LD fields, present or not on either side."""
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("key"), F.lit(label).alias("label"),
                _yes(F.col("user.jsonld.entity")[key]).alias("user_has"),
                _yes(F.col("comp.jsonld.entity")[key]).alias("comp_has"),
                _verdict(_yes(F.col("user.jsonld.entity")[key]), _yes(F.col("comp.jsonld.entity")[key])).alias("verdict"),
            )
            for key, label in K.SCHEMA_FIELDS
        ]
    )


def schema_summary() -> Column:
    """Types, FAQ counts, rating, breadcrumb and the labels only the competitor has."""
    def present(side: str) -> Column:
        return no_nulls(
            *[F.when(_yes(F.col(f"{side}.jsonld.entity")[k]), F.lit(label)) for k, label in K.SCHEMA_FIELDS]
        )

    return F.struct(
        *[
            F.col(f"{side}.jsonld")[field].alias(f"{side}_{name}")
            for side in ("user", "comp")
            for field, name in (
                ("types", "types"), ("has_dental", "has_dental"), ("faq_count", "faq_count"),
                ("rating", "rating"), ("has_breadcrumb", "has_breadcrumb"),
            )
        ],
        F.array_except(present("comp"), present("user")).alias("missing"),
    )


_META_COLUMNS = {
    "title": "title", "description": "meta_description", "ogTitle": "og_title", "ogImage": "og_image",
    "canonical": "canonical", "viewport": "viewport",
}


def meta_rows() -> Column:
    """Six head texts by presence, and robots meta where only noindex matters."""
    rows = []
    for key, label in K.META_FIELDS:
        u = text_or_empty(F.col("user")[_META_COLUMNS[key]])
        c = text_or_empty(F.col("comp")[_META_COLUMNS[key]])
        rows.append(
            F.struct(
                F.lit(key).alias("key"), F.lit(label).alias("label"), u.alias("user_text"), c.alias("comp_text"),
                F.length(u).alias("user_len"), F.length(c).alias("comp_len"),
                _verdict(strip(u) != "", strip(c) != "").alias("verdict"), F.lit(False).alias("warn_user"),
            )
        )
    key, label, none = K.META_ROBOTS
    u, c = text_or_empty(F.col("user.robots_meta")), text_or_empty(F.col("comp.robots_meta"))
    u_no, c_no = F.lower(u).contains("noindex"), F.lower(c).contains("noindex")
    rows.append(
        F.struct(
            F.lit(key).alias("key"), F.lit(label).alias("label"),
            F.when(u == "", none).otherwise(u).alias("user_text"), F.when(c == "", none).otherwise(c).alias("comp_text"),
            F.lit(0).alias("user_len"), F.lit(0).alias("comp_len"),
            F.when(u_no & ~c_no, "gap").otherwise("same").alias("verdict"), u_no.alias("warn_user"),
        )
    )
    return F.array(*rows)


def content_rows() -> Column:
    """Six numbers (the larger wins) and three flags."""
    rows = []
    for key, label, column in K.CONTENT_NUMBERS:
        u = F.coalesce(F.col("user")[column].cast("double"), F.lit(0.0))
        c = F.coalesce(F.col("comp")[column].cast("double"), F.lit(0.0))
        verdict = F.when(c > u, "gap").when(u > c, "ahead").otherwise("same")
        rows.append(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit("num").alias("kind"),
                             u.alias("user_value"), c.alias("comp_value"), verdict.alias("verdict")))
    for key, label, column in K.CONTENT_FLAGS:
        u, c = _yes(F.col("user")[column]), _yes(F.col("comp")[column])
        rows.append(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit("bool").alias("kind"),
                             u.cast("double").alias("user_value"), c.cast("double").alias("comp_value"),
                             _verdict(u, c).alias("verdict")))
    return F.array(*rows)


def _ids(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def plan_rows(
    signals: Column, content: Column | None = None, missing: Column | None = None, user_cited: Column | None = None
) -> Column:
    """What to do first. Open signals, weak content, missing mentions; heaviest first."""
    difficulty = F.create_map(*[F.lit(x) for k, d, _, _ in K.COMPARED_SIGNALS for x in (k, d)])
    products = F.create_map(*[x for k, _, p, _ in K.COMPARED_SIGNALS for x in (F.lit(k), _ids(p))])

    def from_signal(s: Column, position: Column) -> Column:
        ahead = s["verdict"] == "gap"
        severity = (
            s["weight"].cast("double") * F.when(ahead, 2.0).otherwise(1.0)
            * F.when(s["user_status"] == "fail", 1.0).otherwise(0.6)
        )
        detail = F.lit("")
        if missing is not None:
            detail = F.when(
                (s["key"] == "schema") & (F.size(missing) > 0),
                F.concat(F.lit(K.PLAN_SCHEMA_DETAIL), F.array_join(missing, " · ")),
            ).otherwise("")
        return F.struct(
            (-severity).alias("weight"), (position + 1).alias("ord"), s["key"].alias("key"),
            s["label"].alias("item"),
            F.when(s["user_note"] != "", s["user_note"]).otherwise(K.PLAN_CURRENT_DEFAULT).alias("current"),
            F.coalesce(s["fix"], F.lit(K.PLAN_TARGET_DEFAULT)).alias("target"), detail.alias("detail"),
            difficulty[s["key"]].alias("difficulty"), ahead.alias("comp_ahead"), severity.alias("severity"),
            products[s["key"]].alias("product_ids"),
        )

    def extra(key: str, current: Column, position: int) -> Column:
        item, target, detail, hard, severity, ids = K.EXTRA_PLAN_ROWS[key]
        return F.struct(
            F.lit(-severity).alias("weight"), F.lit(position).alias("ord"), F.lit(key).alias("key"),
            F.lit(item).alias("item"), current.alias("current"), F.lit(target).alias("target"),
            F.lit(detail).alias("detail"), F.lit(hard).alias("difficulty"), F.lit(True).alias("comp_ahead"),
            F.lit(severity).alias("severity"), _ids(ids).alias("product_ids"),
        )

    numbered = F.transform(signals, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    open_rows = F.transform(
        F.filter(numbered, lambda x: x["s"]["user_status"] != "ok"), lambda x: from_signal(x["s"], x["i"])
    )
    parts = [open_rows]
    if content is not None:
        weak = F.filter(
            content,
            lambda c: c["key"].isin([k for k, _, _ in K.CONTENT_FLAGS]) & (c["verdict"] == "gap"),
        )
        names = F.array_join(F.transform(weak, lambda c: c["label"]), "·")
        row = extra("citability", F.format_string(K.CITABILITY_CURRENT, names), 100)
        parts.append(F.array_compact(F.array(F.when(F.size(weak) > 0, row))))
    if user_cited is not None:
        row = extra("notcited", F.lit(K.NOTCITED_CURRENT), 0)
        parts.append(F.array_compact(F.array(F.when(~user_cited, row))))
    ordered = F.array_sort(F.concat(*parts))
    return F.transform(
        ordered,
        lambda r, i: F.struct(
            (i + 1).alias("priority"),
            *[r[c].alias(c) for c in ("key", "item", "current", "target", "detail", "difficulty", "comp_ahead", "severity", "product_ids")],
        ),
    )


def recommended_products(plan: Column) -> Column:
    """Follow-up ids in plan order, each once."""
    return F.array_distinct(F.flatten(F.transform(plan, lambda r: r["product_ids"])))


def signal_diff(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    return joined.select(*keys, F.posexplode(signal_rows()).alias("_i", "_r")).select(
        *keys, F.col("_i").alias("signal_ord"), "_r.*"
    )


def schema_diff(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    return joined.select(*keys, F.inline(schema_rows()))


def meta_diff(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    return joined.select(*keys, F.inline(meta_rows()))


def content_diff(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    return joined.select(*keys, F.inline(content_rows()))


def improvement_plan(joined: DataFrame, keys: Sequence[str], user_cited: str | None = None, with_schema: bool = True) -> DataFrame:
    missing = F.col("_missing") if with_schema else None
    base = joined.select(
        *keys, signal_rows().alias("_signals"), content_rows().alias("_content"),
        *([schema_summary()["missing"].alias("_missing")] if with_schema else []),
        *([F.col(user_cited).alias("_cited")] if user_cited else []),
    )
    plan = plan_rows(
        F.col("_signals"), F.col("_content"), missing, F.col("_cited") if user_cited else None
    )
    return base.select(*keys, F.inline(plan))


def gap_buckets(joined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels by bucket for the public comparison, matched by label; both weak is left out."""
    user_items = F.coalesce(F.col("user.items"), F.array())

    def theirs(label: Column) -> Column:
        return F.get(F.filter(F.col("comp.items"), lambda c: c["label"] == label), F.lit(0))

    both = F.filter(
        F.transform(
            user_items,
            lambda u: F.struct(
                u["label"].alias("label"), (u["status"] == "ok").alias("u_ok"),
                (u["measurement"] == "limited").alias("limited"), theirs(u["label"])["status"].alias("c_status"),
            ),
        ),
        lambda x: x["c_status"].isNotNull(),
    )
    c_ok = lambda x: x["c_status"] == "ok"
    tests = {
        "limited": lambda x: x["limited"],
        "gaps": lambda x: ~x["limited"] & ~x["u_ok"] & c_ok(x),
        "same": lambda x: ~x["limited"] & x["u_ok"] & c_ok(x),
        "ahead": lambda x: ~x["limited"] & x["u_ok"] & ~c_ok(x),
    }
    base = joined.select(*keys, both.alias("_both"))
    return base.select(
        *keys,
        *[F.transform(F.filter("_both", t), lambda x: x["label"]).alias(n) for n, t in tests.items()],
    )


def product_triggers(cited: Column, score: Column) -> Column:
    """Follow-ups suggested by exposure and score."""
    low = F.coalesce(score, F.lit(100)) < K.FOLLOW_UP_LOW_SCORE
    uncited = ~F.coalesce(cited, F.lit(False))
    rules = {"always": F.lit(True), "uncited": uncited, "uncited-or-low": uncited | low}
    return no_nulls(*[F.when(rules[rule], F.lit(name)) for name, rule in K.FOLLOW_UPS])


def solutions(plan_keys: Column) -> Column:
    """Solutions whose keys meet the plan, all of them if none does."""
    hits = no_nulls(*[F.when(F.arrays_overlap(plan_keys, _ids(keys)), F.lit(name)) for name, keys in K.SOLUTIONS])
    return F.when(F.size(hits) > 0, hits).otherwise(_ids([name for name, _ in K.SOLUTIONS]))


def compare_package(joined: DataFrame, keys: Sequence[str], user_cited: str | None = None) -> DataFrame:
    """All diffs, plan and follow-ups per pair in one row."""
    first = joined.select(
        *keys, *([user_cited] if user_cited and user_cited not in keys else []),
        F.col("user.score").alias("user_score"), F.col("comp.score").alias("comp_score"),
        signal_rows().alias("signal_diff"), schema_rows().alias("schema_diff"),
        schema_summary().alias("schema_summary"), meta_rows().alias("meta_diff"), content_rows().alias("content_diff"),
    )
    second = first.withColumn(
        "plan_rows",
        plan_rows(
            F.col("signal_diff"), F.col("content_diff"), F.col("schema_summary.missing"),
            F.col(user_cited) if user_cited else None,
        ),
    )
    return second.select(
        "*", recommended_products(F.col("plan_rows")).alias("recommended_products"),
        solutions(F.transform("plan_rows", lambda r: r["key"])).alias("solutions"),
        F.lit(K.EFFECT_LABEL).alias("effect_label"),
    )
