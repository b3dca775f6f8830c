"""History over time: last entries, deltas, trends, months, score against citation.

Rankings that keep k rows use the limit Spark applies before the shuffle. `lag` over a whole
history goes through `group_lag`, which cuts a site's history into slices of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ordered import group_lag, top_k
from ..functions.text import col


def last_n_history(
    history: DataFrame, keys: Sequence[str], now: Column, n: int = K.HISTORY_KEEP, days: int = K.HISTORY_DAYS,
    ts: str = "ts", tiebreak: Sequence[str] = (),
) -> DataFrame:
    """M1: the newest n records per site that are not older than `days` at `now`."""
    fresh = history.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS"))
    order = [F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak]]
    return top_k(fresh, keys, order, n, "hist_no")


def score_delta(
    history: DataFrame, keys: Sequence[str], ts: str = "ts", tiebreak: Sequence[str] = (), band: str | None = None,
    slice_unit: str | None = "month",
) -> DataFrame:
    """M2: previous score (and band), difference and direction for every record.

    `slice_unit` is the `date_trunc` unit that keeps (site, unit) in one task. None keeps a site in one: over a history
    that is bucketed by site nothing is exchanged then.
    """
    values = {"prev_score": "score", **({"prev_band": band} if band else {})}
    if slice_unit is None:
        before = Window.partitionBy(*keys).orderBy(ts, *tiebreak)
        looked = history.withColumns({out: F.lag(name).over(before) for out, name in values.items()})
    else:
        looked = group_lag(history, keys, [ts, *tiebreak], F.date_trunc(slice_unit, F.col(ts)), values)
    delta = F.col("score") - F.col("prev_score")
    return looked.withColumn("delta", delta).withColumn(
        "direction",
        F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "same").otherwise("first"),
    )


def trend(
    history: DataFrame, keys: Sequence[str], ts: str = "ts", tiebreak: Sequence[str] = (), points: int = K.TREND_POINTS
) -> DataFrame:
    """M3: first and last of the newest `points` scores and their difference, in time order."""
    order = [F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak]]
    kept = top_k(history, keys, order, points, "_no")
    ends = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.max_by("score", "_no").alias("first_score"),
        F.min_by("score", "_no").alias("last_score"),
    )
    change = F.col("last_score") - F.col("first_score")
    return ends.where(F.col("points") >= 2).withColumn("change", change)


def citation_history_matrix(
    history: DataFrame, rows: Sequence[str], engines: Sequence[str] = tuple(K.AUTO_ENGINES)
) -> DataFrame:
    """M4: one row per record, one column per engine: cited/valid, NULL if the engine is absent.

    `history` holds `engines ARRAY<STRUCT<engine, cited, cited_runs, valid_runs>>`; the pivot is an
    array lookup in the row, so nothing shuffles.
    """
    def cell(engine: str) -> Column:
        hit = F.get(F.filter("engines", lambda e: e["engine"] == engine), F.lit(0))
        return F.when(
            hit.isNotNull(),
            F.concat_ws("/", hit["cited_runs"].cast("string"), hit["valid_runs"].cast("string")),
        ).alias(engine)

    return history.select(*rows, *[cell(e) for e in engines])


def citation_record(panel: DataFrame, keys: Sequence[str], ts: Column) -> DataFrame:
    """The history record of a panel: at most one entry per engine."""
    entry = F.struct("engine", "cited", "cited_runs", "valid_runs")
    return panel.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("engines")).withColumn("ts", ts)


def sanitize_monthly(raw: DataFrame, fields: Sequence[tuple[str, float]] = K.MONTHLY_FIELDS) -> DataFrame:
    """M7: known fields as numbers inside their range, anything else becomes NULL."""
    def clean(name: str, top: float) -> Column:
        number = F.trim(F.col(name).cast("string")).try_cast("double")
        return F.when(number.between(0.0, top), number).alias(name)

    known = dict(fields)
    return raw.select(*[clean(c, known[c]) if c in known else F.col(c) for c in raw.columns])


def latest_monthly(rows: DataFrame, keys: Sequence[str] = ("domain", "period"), saved: str = "saved_at", tiebreak: Sequence[str] = ()) -> DataFrame:
    """A10 merge rule: per domain and month the last write wins. One pass of max_by, no sort."""
    body = F.struct(*[c for c in rows.columns if c not in keys])
    order = F.struct(saved, *tiebreak)
    kept = rows.groupBy(*keys).agg(F.max_by(body, order).alias("_row"))
    return kept.select(*keys, "_row.*")


def month_list(now: Column, n: int) -> Column:
    """The last n months as YYYY-MM, newest first."""
    count = max(1, min(int(n), 12))
    start = F.trunc(now, "month")
    return F.array(*[F.date_format(F.add_months(start, -i), "yyyy-MM") for i in range(count)])


def recent_months(monthly: DataFrame, now: Column, n: int = 6, period: str = "period") -> DataFrame:
    """M6: records of the last n months (1 to 12); months without a record are absent.

    The wanted months are a short list, so this is a filter that reaches the scan, not a join.
    """
    return monthly.where(F.array_contains(month_list(now, n), F.col(period)))


def days_since(reviewed: Column | str, now: Column) -> Column:
    stamp = F.try_to_timestamp(col(reviewed))
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(stamp)) / F.lit(86400000000.0)


def is_stale(reviewed: Column | str, now: Column, max_days: int = K.STALE_MAX_DAYS) -> Column:
    """M8: older than the limit, or no readable date."""
    return F.coalesce(days_since(reviewed, now) > max_days, F.lit(True))


def score_vs_citation(scores: DataFrame, panel: DataFrame, site: str = "site") -> DataFrame:
    """Does the score go with exposure? Correlation, rate per band, unmeasurable share.

    `scores`: one row per site with score and band. A site without a panel row or without a
    measured engine is unmeasurable: it counts as a site and leaves the correlation.
    """
    seen = panel.groupBy(site).agg(
        F.bool_or("measured").alias("measured"),
        F.bool_or(F.coalesce(F.when(F.col("measured"), F.col("exposed")), F.lit(False))).alias("exposed"),
    )
    joined = scores.join(seen, site, "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    measured = F.col("measured")
    hit = F.when(measured, F.col("exposed").cast("double"))
    return joined.groupingSets([["band"], []], "band").agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(measured).alias("measured_sites"),
        F.count_if(measured & F.col("exposed")).alias("exposed_sites"),
        F.round(F.avg(hit), 4).alias("exposure_rate"),
        F.round(F.corr(F.when(measured, F.col("score").cast("double")), hit), 4).alias("correlation"),
        F.round(F.avg((~measured).cast("double")), 4).alias("unmeasurable_share"),
    ).withColumn("band", F.coalesce("band", F.lit("(all)")))


def repeatability(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How far repeated scores of one page lie apart."""
    counted = history.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("measurements"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.round(F.stddev_pop("score"), 4).alias("score_stddev"),
    )
    return counted.where(F.col("measurements") >= 2).withColumn("spread", F.col("max_score") - F.col("min_score"))


def measurability(reason: Column | str, needs_render: Column | str | None = None) -> Column:
    """State of a measurement from the fetch reason: never a zero in disguise."""
    why = F.lower(F.coalesce(col(reason), F.lit("")))
    render = F.coalesce(col(needs_render), F.lit(False)) if needs_render is not None else F.lit(False)
    return (
        F.when(why.contains("timeout"), "timeout")
        .when(why.rlike("cert"), "unmeasurable:cert")
        .when(why.rlike("tls|ssl"), "unmeasurable:tls")
        .when(
            why.rlike("blocked-ip|bad-scheme|bad-port|userinfo|invalid-url|too-many-redirects|body-too-large|blocked"),
            "unmeasurable:blocked",
        )
        .when(why != "", "vendor-failure")
        .when(render, "render-needed")
        .otherwise("measured")
    )

