"""Planning a measurement: query variants, prompts, regions, run manifest, budget, cache key.

Rows multiply only by exploding short arrays (templates, engines, repeats), never by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import col, squeeze, strip, text_or_empty


def _fill(template: str, parts: dict[str, Column]) -> Column:
    """A template as a concatenation, so that inserted text is never searched for placeholders."""
    pieces: list[Column] = []
    text = ""
    i = 0
    while i < len(template):
        if template[i] == "{":
            if text:
                pieces.append(F.lit(text))
                text = ""
            pieces.append(parts[template[i + 1]])
            i += 3
        else:
            text += template[i]
            i += 1
    if text:
        pieces.append(F.lit(text))
    return F.concat(*pieces)


def _parts(district: Column | str, procedure: Column | str, business: Column | str) -> dict[str, Column]:
    trade = strip(text_or_empty(business))
    return {
        "d": strip(text_or_empty(district)),
        "p": strip(text_or_empty(procedure)),
        "b": F.when(text_or_empty(business) == "", K.DEFAULT_BUSINESS).otherwise(trade),
    }


def variant_array(
    district: Column | str, procedure: Column | str, business: Column | str | None = None
) -> Column:
    """B1 as array<string>: four base variants, then those whose conditions hold."""
    parts = _parts(district, procedure, F.lit("") if business is None else business)
    has_d, has_p = parts["d"] != "", parts["p"] != ""
    rows = []
    for i, (need_d, need_p, no_d, no_p, template) in enumerate(K.QUERY_TEMPLATES):
        text = _fill(template, parts)
        if i < K.BASE_TEMPLATES:
            text = squeeze(text)
        keep = F.lit(True)
        for wanted, test in ((need_d, has_d), (need_p, has_p), (no_d, ~has_d), (no_p, ~has_p)):
            if wanted:
                keep = keep & test
        rows.append(F.when(keep, text))
    return F.array_compact(F.array(*rows))


def query_variants(targets: DataFrame) -> DataFrame:
    """B1: targets (district, procedure, business_type, ...) x variants, `ordinal` from 0."""
    variants = variant_array("district", "procedure", "business_type")
    return targets.select("*", F.posexplode(variants).alias("ordinal", "prompt"))


def system_text(district: Column | str, business: Column | str) -> Column:
    parts = _parts(district, F.lit(""), business)
    place = F.when(parts["d"] == "", K.SYSTEM_DEFAULT_PLACE).otherwise(parts["d"])
    return _fill(K.SYSTEM_TEXT, {**parts, "d": place})


def default_prompts(targets: DataFrame) -> DataFrame:
    """B2: the first four variants with their system text."""
    first = query_variants(targets).where(F.col("ordinal") < K.BASE_TEMPLATES)
    return first.withColumn("system", system_text("district", "business_type"))


def clean_indexes(indexes: Column | str, count: Column) -> Column:
    """Whole numbers in [0, count), distinct in order, at most three."""
    numbers = F.transform(col(indexes), lambda x: x.try_cast("double"))
    valid = F.filter(numbers, lambda x: (x == F.floor(x)) & (x >= 0) & (x < count))
    return F.slice(F.array_distinct(F.transform(valid, lambda x: x.cast("int"))), 1, K.MAX_CUSTOM_QUERIES)


def clean_custom(custom: Column | str) -> Column:
    """The first three own queries, trimmed, 300 characters, blanks dropped."""
    head = F.slice(col(custom), 1, K.MAX_CUSTOM_QUERIES)
    return F.filter(
        F.transform(head, lambda q: F.substring(strip(text_or_empty(q)), 1, 300)), lambda q: q != ""
    )


def select_prompts(targets: DataFrame) -> DataFrame:
    """`prompts` from chosen variant indexes, else own queries, else the default four.

    Columns read: district, procedure, business_type, query_indexes, queries.
    """
    filled = targets.withColumn("_v", variant_array("district", "procedure", "business_type"))
    cleaned = filled.withColumn(
        "_i", F.coalesce(clean_indexes("query_indexes", F.size("_v")), F.array().cast("array<int>"))
    ).withColumn("_c", F.coalesce(clean_custom("queries"), F.array().cast("array<string>")))
    prompts = (
        F.when(F.size("_i") > 0, F.transform("_i", lambda i: F.get("_v", i)))
        .when(F.size("_c") > 0, F.col("_c"))
        .otherwise(F.slice("_v", 1, K.BASE_TEMPLATES))
    )
    fingerprint = (
        F.when(
            F.size("_i") > 0,
            F.concat(F.lit("indexes:"), F.array_join(F.transform("_i", lambda i: i.cast("string")), ",")),
        )
        .when(F.size("_c") > 0, F.substring(F.array_join(F.array_sort("_c"), "§"), 1, 120))
        .otherwise("")
    )
    return cleaned.select(*targets.columns, prompts.alias("prompts"), fingerprint.alias("query_fp"))


def normalize_regions(regions: Column | str, region: Column | str) -> Column:
    """Up to five distinct non-blank regions; a non-empty list wins over the single one."""
    listed = F.filter(
        F.transform(col(regions), lambda r: F.substring(strip(text_or_empty(r)), 1, 40)),
        lambda r: r != "",
    )
    many = F.slice(F.array_distinct(listed), 1, K.MAX_REGIONS)
    single = F.array(strip(text_or_empty(region)))
    return F.when((F.coalesce(F.size(col(regions)), F.lit(0)) > 0) & (F.size(many) > 0), many).when(
        F.coalesce(F.size(col(regions)), F.lit(0)) > 0, F.array(F.lit(""))
    ).otherwise(single)


def clamp_repeats(repeats: Column | str) -> Column:
    n = F.coalesce(col(repeats).try_cast("int"), F.lit(0))
    return F.greatest(F.lit(1), F.least(F.when(n == 0, 1).otherwise(n), F.lit(K.MAX_REPEATS)))


def request_json(engine: Column, system: Column, prompt: Column, city: Column) -> Column:
    """The request body of one call, in the shape of its engine."""
    place = F.when(text_or_empty(city) != "", city)
    where = F.struct(
        F.lit("approximate").alias("type"), F.lit("KR").alias("country"),
        F.lit("Asia/Seoul").alias("timezone"), place.alias("city"), place.alias("region"),
    )

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    chatgpt = F.struct(
        F.lit(K.DEFAULT_MODELS["chatgpt"]).alias("model"),
        F.array(F.struct(F.lit("web_search").alias("type"), where.alias("user_location"))).alias("tools"),
        F.lit("required").alias("tool_choice"),
        F.array(message("system", system), message("user", prompt)).alias("input"),
    )
    perplexity = F.struct(
        F.lit(K.DEFAULT_MODELS["perplexity"]).alias("model"),
        F.array(message("user", prompt)).alias("messages"),
        F.struct(
            F.struct(F.lit("KR").alias("country"), place.alias("city"), place.alias("region")).alias("user_location")
        ).alias("web_search_options"),
    )
    claude = F.struct(
        F.lit(K.DEFAULT_MODELS["claude"]).alias("model"),
        F.lit(1024).alias("max_tokens"),
        F.concat(system, F.lit("\n" + K.FORCE_SEARCH_NOTE)).alias("system"),
        F.struct(F.lit("tool").alias("type"), F.lit("web_search").alias("name")).alias("tool_choice"),
        F.array(message("user", prompt)).alias("messages"),
        F.array(
            F.struct(
                F.lit("web_search_20250305").alias("type"), F.lit("web_search").alias("name"),
                F.lit(3).alias("max_uses"), where.alias("user_location"),
            )
        ).alias("tools"),
    )
    return (
        F.when(engine == "chatgpt", F.to_json(chatgpt))
        .when(engine == "claude", F.to_json(claude))
        .when(engine == "perplexity", F.to_json(perplexity))
    )


def run_manifest(
    targets: DataFrame, engines: Sequence[str] = tuple(K.AUTO_ENGINES), repeats: Column | str | None = None
) -> DataFrame:
    """One row per call: target x region x engine x prompt x repeat, with the request.

    `targets` needs regions ARRAY, prompts ARRAY, district and business_type.
    """
    times = clamp_repeats(repeats if repeats is not None else F.lit(K.MAX_REPEATS))
    base = [c for c in targets.columns if c not in ("regions", "prompts")]
    names = F.array(*[F.lit(e) for e in engines])
    calls = (
        targets.withColumn("_times", times)
        .select(*base, "prompts", "_times", F.explode("regions").alias("region"))
        .select(*base, "prompts", "_times", "region", F.explode(names).alias("engine"))
        .select(*base, "_times", "region", "engine", F.posexplode("prompts").alias("prompt_no", "prompt"))
        .select(
            *base, "region", "engine", "prompt_no", "prompt",
            F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("rep"),
        )
    )
    system = system_text("region", "business_type")
    return calls.withColumn(
        "request", request_json(F.col("engine"), system, F.col("prompt"), F.col("region"))
    )


def call_budget(manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls per target and the note, from the manifest itself."""
    counted = manifest.groupBy(*keys).agg(
        F.count_distinct("region").alias("regions"), F.count_distinct("engine").alias("engines"),
        F.count_distinct("prompt_no").alias("queries"), F.max("rep").alias("repeats"),
        F.count(F.lit(1)).alias("calls"),
    )
    return counted.withColumn(
        "note", F.format_string(K.COST_NOTE, "regions", "engines", "queries", "repeats", "calls")
    )


def cache_key(domain: Column, regions: Column, procedure: Column, query_fp: Column) -> Column:
    """Equal for equal measurements; the order of regions does not matter."""
    what = F.lower(strip(text_or_empty(procedure)))
    many = F.concat_ws("|", F.lit("multi"), domain, F.array_join(F.array_sort(regions), "‖"), what, query_fp)
    one = F.concat_ws("|", domain, F.lower(text_or_empty(F.get(regions, F.lit(0)))), what, query_fp)
    return F.when(F.size(regions) > 1, many).otherwise(one)
