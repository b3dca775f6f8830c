"""Nine score items, bands, gates, axes and fixes.

Input: one wide row per page with the signal columns of `signals.page_signals` and a `robots`
struct (NULL if there is no robots file for the host). Missing signals count as absent where they
are used, never at ingest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ordered import top_k
from ..functions.stats import ratio
from ..functions.text import no_nulls

LIMITED = [key for key, _, _, _, axis, _ in K.SCORE_ITEMS if axis == "content"]


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def _number(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)


def _profile(df: DataFrame, name: str, kind: str = "flag") -> Column:
    """A JSON-LD fact, from the `jsonld` struct or from a plain column of the same name."""
    if "jsonld" in df.columns and name in df.schema["jsonld"].dataType.names:
        value = F.col("jsonld")[name]
    elif name in df.columns:
        value = F.col(name)
    else:
        value = F.lit(None)
    if kind == "list":
        return F.coalesce(value.cast("array<string>"), F.array().cast("array<string>"))
    if kind == "number":
        return F.coalesce(value.cast("bigint"), F.lit(0))
    return F.coalesce(value.cast("boolean"), F.lit(False))


def _mark(flag: Column) -> Column:
    return F.when(flag, "O").otherwise("X")


def _status(points: Column, ok: int) -> Column:
    return F.when(points >= ok, "ok").when(points > 0, "warn").otherwise("fail")


def _steps(value: Column, *steps: tuple[float, int]) -> Column:
    """Points of the first threshold the value reaches."""
    chain = F.when(value >= steps[0][0], steps[0][1])
    for cut, points in steps[1:]:
        chain = chain.when(value >= cut, points)
    return chain.otherwise(0)


def _item(key: str, points: Column, status: Column, note: Column, fix: Column) -> Column:
    order = [k for k, *_ in K.SCORE_ITEMS].index(key)
    _, label, top, layer, axis, why = K.SCORE_ITEMS[order]
    return F.struct(
        F.lit(order).alias("item_ord"), F.lit(key).alias("key"), F.lit(label).alias("label"),
        F.lit(layer).alias("layer"), F.lit(axis).alias("axis"), points.cast("int").alias("points"),
        F.lit(top).alias("max"), status.alias("status"), note.alias("note"), fix.alias("fix"),
        F.lit(why).alias("why"),
    )


def _crawl(df: DataFrame) -> Column:
    if "robots" not in df.columns:
        absent = F.lit(K.NOTE_TEXT["crawl-absent"])
        return _item("crawl", F.lit(11), F.lit("warn"), absent, F.lit(K.FIX_TEXT["crawl-absent"]))
    r = F.col("robots")
    present = F.coalesce(r["present"], F.lit(False))
    blocked = present & F.coalesce(r["blocks_any"], F.lit(False))
    partial = present & (F.coalesce(F.size(r["partial_blocks"]), F.lit(0)) > 0)
    paths = F.array_join(F.flatten(F.transform(r["partial_blocks"], lambda p: p["paths"])), " ")
    training = present & (F.coalesce(F.size(r["blocked_training"]), F.lit(0)) > 0)
    points = F.when(blocked, 2).when(partial, 9).when(present, 15).otherwise(11)
    status = F.when(blocked, "fail").when(partial, "warn").when(present, "ok").otherwise("warn")
    note = (
        F.when(blocked | partial | training, r["note"])
        .when(present, K.ROBOTS_OPEN_NOTE)
        .otherwise(K.NOTE_TEXT["crawl-absent"])
    )
    fix = (
        F.when(
            blocked,
            F.format_string(K.FIX_TEXT["crawl-blocked"], F.array_join(r["blocked_citation"], ", ")),
        )
        .when(partial, F.format_string(K.FIX_TEXT["crawl-partial"], paths))
        .when(~present, K.FIX_TEXT["crawl-absent"])
    )
    return _item("crawl", points, status, note, fix)


def item_array(df: DataFrame) -> Column:
    """F1 to F9 as one array of nine structs, in item order."""
    render = _flag(df, "needs_render")
    dental, trust, faq = (_profile(df, n) for n in ("has_dental", "has_trust", "has_faq"))
    authority = _flag(df, "has_same_as_authority") | _profile(df, "has_same_as_authority")
    types = _profile(df, "types", "list")

    schema_points = F.least(
        F.lit(10), dental.cast("int") * 7 + trust.cast("int") * 3 + faq.cast("int") * 2
        + authority.cast("int") * 2,
    )
    type_names = F.array_join(F.slice(types, 1, 6), ", ")
    schema_note = F.when(
        _profile(df, "count", "number") > 0,
        F.concat(
            F.lit("JSON-LD: "),
            F.when(type_names != "", type_names).otherwise(K.NOTE_TEXT["schema-empty"]),
        ),
    ).otherwise(K.NOTE_TEXT["schema-none"])
    schema_fix = (
        F.when(~dental, K.FIX_TEXT["schema-dental"])
        .when(~trust, K.FIX_TEXT["schema-trust"])
        .when(~authority, K.FIX_TEXT["schema-authority"])
    )

    band = _number(df, "price_band")
    price_points = _steps(band, (2, 5), (1, 3))
    price_note = (
        F.when(_flag(df, "has_price_table"), K.NOTE_TEXT["price-table"])
        .when(
            _number(df, "price_item_count") > 0,
            F.format_string(K.NOTE_TEXT["price-items"], _number(df, "price_item_count")),
        )
        .when(_flag(df, "has_price_notice"), K.NOTE_TEXT["price-notice"])
        .otherwise(K.NOTE_TEXT["price-none"])
    )

    share, scripts = _number(df, "sn").cast("double"), _number(df, "scripts")
    read = _steps(share, (0.06, 6), (0.02, 3)) + F.when(scripts <= 25, 4).when(scripts <= 50, 2).otherwise(0)
    extract_points = F.when(render, F.least(read, F.lit(2))).otherwise(read)
    extract_note = F.format_string(
        K.NOTE_TEXT["extract"], share * 100, scripts,
        F.when(render, K.NOTE_TEXT["extract-render"]).otherwise(""),
    )

    phone, address = _flag(df, "phone"), _flag(df, "address")
    local_points = phone.cast("int") * 4 + address.cast("int") * 4 + dental.cast("int") * 2

    creds, social = _number(df, "credentials"), _number(df, "social")
    eeat_points = _steps(creds, (4, 10), (1, 6)) + _steps(social, (1, 5))

    dates = _number(df, "date_signals")
    fresh_points = _steps(dates, (2, 10), (1, 6))

    answer_points = (
        _steps(_number(df, "h1_count"), (1, 2)) + _steps(_number(df, "h2_count"), (3, 2))
        + _steps(_number(df, "question_h2"), (1, 3)) + _steps(_number(df, "tables"), (1, 2))
        + _steps(_number(df, "faq_blocks"), (1, 1))
    )

    sources, quotes = _flag(df, "has_cited_sources"), _flag(df, "has_quotations")
    stats = _number(df, "stat_count")
    citable_points = sources.cast("int") * 7 + _steps(stats, (2, 4), (1, 2)) + quotes.cast("int") * 4
    stat_note = F.when(stats >= 2, K.NOTE_TEXT["stats"][2]).when(stats >= 1, K.NOTE_TEXT["stats"][1]).otherwise(
        K.NOTE_TEXT["stats"][0]
    )
    citable_fix = (
        F.when(~sources, K.FIX_TEXT["citable-sources"])
        .when(~quotes, K.FIX_TEXT["citable-quotes"])
        .when(stats < 2, K.FIX_TEXT["citable-stats"])
    )

    def text(name: str, *values: Column) -> Column:
        return F.format_string(K.NOTE_TEXT[name], *values)

    def fix_below(points: Column, cut: int, name: str) -> Column:
        return F.when(points < cut, K.FIX_TEXT[name])

    return F.array(
        _crawl(df),
        _item("schema", schema_points, _status(schema_points, 8), schema_note, schema_fix),
        _item("price", price_points, _status(price_points, 5), price_note, F.when(band < 2, K.FIX_TEXT["price"])),
        _item("extract", extract_points, _status(extract_points, 7), extract_note, fix_below(extract_points, 7, "extract")),
        _item("local", local_points, _status(local_points, 8),
              text("local", _mark(phone), _mark(address), _mark(dental)), fix_below(local_points, 8, "local")),
        _item("eeat", eeat_points, _status(eeat_points, 11), text("eeat", creds, social),
              F.when(creds < 4, K.FIX_TEXT["eeat"])),
        _item("fresh", fresh_points, _status(fresh_points, 10), text("fresh", dates), fix_below(fresh_points, 10, "fresh")),
        _item("answer", answer_points, _status(answer_points, 8),
              text("answer", _number(df, "question_h2"), _number(df, "tables"), _number(df, "faq_blocks")),
              fix_below(answer_points, 8, "answer")),
        _item("citable", citable_points, _status(citable_points, 11),
              text("citable", _mark(sources), _mark(quotes), stat_note), citable_fix),
    )


def mark_limited(items: Column, needs_render: Column) -> Column:
    """content items of a page that needs rendering are limited, not failed."""
    limited = F.coalesce(needs_render, F.lit(False))

    def one(x: Column) -> Column:
        hit = limited & x["key"].isin(LIMITED)
        return F.struct(
            *[x[c].alias(c) for c in ("item_ord", "key", "label", "layer", "axis", "points", "max")],
            F.when(hit & (x["status"] == "fail"), "warn").otherwise(x["status"]).alias("status"),
            F.when(hit, F.concat(F.lit(K.LIMITED_PREFIX), x["note"])).otherwise(x["note"]).alias("note"),
            F.when(~hit, x["fix"]).alias("fix"),
            x["why"].alias("why"),
            F.when(hit, "limited").otherwise("measured").alias("measurement"),
        )

    return F.transform(items, one)


def _items(signals: DataFrame) -> Column:
    return mark_limited(item_array(signals), _flag(signals, "needs_render"))


def with_items(signals: DataFrame, out: str = "items") -> DataFrame:
    return signals.withColumn(out, _items(signals))


def score_items(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F1 to F10 as a long table: one row per page and item."""
    # Of a column, Spark would ask first whether it is empty, and build the items twice.
    return signals.select(*keys, F.inline(_items(signals)))


def band_of(score: Column) -> Column:
    """label of a score."""
    chain = F.when(score >= K.BAND_CUTS[2], K.BANDS[3])
    chain = chain.when(score >= K.BAND_CUTS[1], K.BANDS[2]).when(score >= K.BAND_CUTS[0], K.BANDS[1])
    return chain.otherwise(K.BANDS[0])


def total_band(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F11 over the long table."""
    total = items.groupBy(*keys).agg(F.sum("points").alias("score"))
    return total.withColumn("raw_band", band_of(F.col("score")))


def axes(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F13 over the long table: points and maximum of the two axes."""
    def part(axis: str, column: str) -> Column:
        return F.sum(F.when(F.col("axis") == axis, F.col(column)).otherwise(0))

    return items.groupBy(*keys).agg(
        *[
            part(axis, source).alias(f"{axis}_{name}")
            for axis in ("tech", "content")
            for name, source in (("score", "points"), ("max", "max"))
        ]
    )


def top_fixes(items: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """F14 over the long table: the k open items with the largest gain, item order on ties."""
    gain = F.col("max") - F.col("points")
    order = [gain.desc(), F.col("item_ord").asc()]
    best = top_k(items.where(F.col("fix").isNotNull()), keys, order, k, "fix_rank")
    return best.select(
        *keys, "fix_rank", "key", "label", "fix", gain.alias("gain"),
        F.lit(K.GAIN_LABEL).alias("gain_label"), F.col("why").alias("note"),
    )


def band_gates(crawl_blocked: Column, citable: Column, citable_measured: Column, limited: Column) -> Column:
    """codes of the reasons that cap the band, in fixed order."""
    flags = [crawl_blocked, citable_measured & (citable == 0), limited]
    return no_nulls(*[F.when(f, F.lit(code)) for f, (code, _) in zip(flags, K.BAND_GATES)])


def page_scores(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F1 to F14 per page without leaving the row: score, band, gates, axes, top fixes, items."""
    scored = with_items(signals)
    items = F.col("items")

    def points_of(axis: str | None) -> Column:
        chosen = items if axis is None else F.filter(items, lambda x: x["axis"] == axis)
        return F.aggregate(chosen, F.lit(0), lambda a, x: a + x["points"])

    citable = F.get(F.filter(items, lambda x: x["key"] == "citable"), F.lit(0))
    robots = F.col("robots") if "robots" in signals.columns else None
    blocked = (
        F.coalesce(robots["present"] & robots["blocks_any"], F.lit(False)) if robots is not None else F.lit(False)
    )
    limited = _flag(signals, "needs_render")
    gained = F.array_sort(
        F.transform(
            F.filter(items, lambda x: x["fix"].isNotNull()),
            lambda x: F.struct(
                (x["points"] - x["max"]).alias("loss"), x["item_ord"].alias("item_ord"),
                x["key"].alias("key"), x["label"].alias("label"), x["fix"].alias("fix"),
            ),
        )
    )
    fixes = F.transform(
        F.slice(gained, 1, 3),
        lambda x: F.struct(
            x["key"].alias("key"), x["label"].alias("label"), x["fix"].alias("fix"), (-x["loss"]).alias("gain")
        ),
    )
    first = scored.select(
        *keys, *[c for c in ("needs_render",) if c in signals.columns and c not in keys], "items",
        points_of(None).alias("score"), points_of("tech").alias("tech_score"),
        points_of("content").alias("content_score"),
        band_gates(blocked, citable["points"], citable["measurement"] == "measured", limited).alias("band_gates"),
        fixes.alias("top_fixes"),
    )
    raw = band_of(F.col("score"))
    capped = (F.size("band_gates") > 0) & (raw == K.BANDS[3])
    labels = F.create_map(*[F.lit(x) for pair in K.BAND_GATES for x in pair])
    named = F.array_join(F.transform("band_gates", lambda g: labels[g]), " · ")
    return first.select(
        "*", raw.alias("raw_band"), F.when(capped, K.BAND_CAP).otherwise(raw).alias("band"),
        capped.alias("band_capped"),
        F.when(capped, F.format_string(K.CAP_NOTE, named, F.col("score"), raw)).alias("band_note"),
    )


def verdict_line(score: Column, band_note: Column) -> Column:
    """one sentence; a capped band speaks first."""
    chain = F.when(band_note.isNotNull(), band_note)
    for cut, text in K.VERDICTS[:-1]:
        chain = chain.when(score >= cut, text)
    return chain.otherwise(K.VERDICTS[-1][1])


def agent_readiness(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """can an agent operate the forms? A share of checks, never part of the score."""
    f = F.col("forms")
    total, named = f["controls_total"], f["controls_named"]
    status = (
        F.when(F.coalesce(F.col("needs_render"), F.lit(False)), "measurement-limited")
        .when(F.coalesce(f["forms"], F.lit(0)) == 0, "no-form")
        .when(F.coalesce(total, F.lit(0)) == 0, "no-controls")
        .otherwise("measured")
    )
    share = ratio(named, total)
    weak = F.when(named > 0, ratio(f["placeholder_only"], named)).otherwise(F.lit(1.0))
    measured = F.col("status") == "measured"
    checks = {
        "control_names": share >= K.FORM_COVERAGE_GATE,
        "submit_name": (f["submit_total"] > 0) & (f["submit_named"] >= f["submit_total"]),
        "not_placeholder_only": (named > 0) & (weak <= K.FORM_PLACEHOLDER_MAX),
    }
    passed = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks.values()), F.lit(0))
    return signals.withColumn("status", status).select(
        *keys, "status",
        F.coalesce(f["forms"], F.lit(0)).alias("forms"),
        F.coalesce(f["booking_forms"], F.lit(0)).alias("booking_forms"),
        F.when(measured, total).alias("controls_total"),
        F.when(measured, named).alias("controls_named"),
        F.when(measured, F.round(share, 2)).alias("coverage"),
        *[F.when(measured, c).alias(n) for n, c in checks.items()],
        F.when(measured, passed).alias("passed"),
        F.when(measured, F.lit(len(checks))).alias("total"),
        F.when(measured, f["unnamed_samples"]).alias("unnamed_samples"),
    )
