"""Sinks. Appends are partitioned by day, upserts rewrite only the months they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ordered import group_row_number
from ..functions.text import strip, text_or_empty
from ..operators.history import latest_monthly
from . import commits


def with_day(records: DataFrame, ts: str = "ts") -> DataFrame:
    return records.withColumn("day", F.to_date(ts))


def append_history(records: DataFrame, path: str, kind: str, ts: str = "ts") -> None:
    """Append score or citation records under `path/kind`, one folder per day."""
    with_day(records, ts).write.mode("append").partitionBy("day").parquet(f"{path}/{kind}")


def read_history(spark: SparkSession, path: str, kind: str, since: Column | None = None) -> DataFrame:
    """History back; `since` (a date) prunes whole day folders."""
    rows = spark.read.parquet(f"{path}/{kind}")
    return rows.where(F.col("day") >= since) if since is not None else rows


def upsert_monthly(rows: DataFrame, path: str, keys: Sequence[str] = ("domain", "period"), saved: str = "saved_at", **options) -> int:
    """A10: last write wins per (domain, period), in one atomic commit (see `commits`); gives its number.

    Only months present in `rows` are read and written. A column whose type differs from the stored one raises before
    anything is written. `read_monthly` reads the table.
    """
    def combine(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        if stored is None:
            return latest_monthly(new, keys, saved)
        kinds = dict(stored.dtypes)
        other = [f"{c}: {kinds[c]} stored, {t} given" for c, t in new.dtypes if c in kinds and kinds[c] != t]
        if other:
            raise ValueError("column types differ: " + "; ".join(other))
        return latest_monthly(stored.unionByName(new, allowMissingColumns=True), keys, saved)

    return commits.merge(rows, path, combine, **options)


def read_monthly(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The monthly table at its newest commit, or at an earlier one."""
    return commits.read(spark, path, version)


def lead_problem(is_public: Column) -> Column:
    """Why a lead is rejected, NULL if it is fine."""
    def blank(name: str) -> Column:
        return strip(text_or_empty(name)) == ""

    bad_mail = ~strip(text_or_empty("email")).rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    return (
        F.when(blank("clinic_name"), "missing-clinicName")
        .when(is_public & bad_mail, "invalid-email")
        .when(~is_public & blank("contact_name"), "missing-contactName")
        .when(~is_public & blank("phone"), "missing-phone")
        .when(~is_public & (F.coalesce(F.size("selected_products"), F.lit(0)) == 0), "missing-selectedProducts")
    )


def limit_leads(leads: DataFrame, ip: str = "ip_hash", ts: str = "ts", order: str = "request_id", per_hour: int = K.LEADS_PER_HOUR) -> DataFrame:
    """A11, hourly limit: public leads beyond the first `per_hour` of an address and clock hour get `rate_limited`.

    Numbers come from slices of a minute, so no address or hour is sorted in one task.
    """
    public = text_or_empty("source") == K.PUBLIC_LEAD["source"] if "source" in leads.columns else F.lit(True)
    hour = leads.withColumn("_hour", F.date_trunc("hour", F.col(ts))).withColumn("_public", public)
    numbered = group_row_number(hour, ["_public", "_hour", ip], [ts, order], F.date_trunc("minute", F.col(ts)), "_no")
    return numbered.withColumn("rate_limited", F.col("_no") > per_hour).drop("_public", "_hour", "_no")


def prepare_leads(leads: DataFrame, now: Column, public: dict[str, str] = K.PUBLIC_LEAD) -> DataFrame:
    """Leads (source, domain, clinic_name, contact_name, phone, email, selected_products,
    notes, geo_score, ai_cited) with `reject_reason`, clamped fields, time, id and status."""
    is_public = text_or_empty("source") == public["source"]
    judged = leads.withColumn("reject_reason", lead_problem(is_public))
    if "rate_limited" in leads.columns:
        limited = is_public & F.coalesce("rate_limited", F.lit(False))
        judged = judged.withColumn("reject_reason", F.when(limited, "rate-limited").otherwise(F.col("reject_reason"))).drop("rate_limited")
    unified = judged.select(
        *[F.when(is_public, shaped_value(c, public)).otherwise(F.col(c)).alias(c) for c in judged.columns if c != "source"]
    )
    clamped = unified.withColumns({
        name: F.substring(strip(text_or_empty(name)), 1, size) for name, size in K.LEAD_LIMITS
    }).withColumns({
        "selected_products": F.transform(F.slice("selected_products", 1, 10), lambda p: F.substring(p, 1, 100)),
        "ai_cited": F.coalesce("ai_cited", F.lit(False)), "submitted_at": now, "status": F.lit(K.LEAD_STATUS_NEW),
    })
    site = F.when(F.col("domain") == "", "unknown").otherwise(F.substring("domain", 1, 60))
    stamp = F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return clamped.withColumn("lead_id", F.concat(F.lit("lead:"), stamp, F.lit(":"), site))


def shaped_value(name: str, public: dict[str, str]) -> Column:
    """What a public lead carries in a common column."""
    phone = strip(text_or_empty("phone"))
    fixed = {
        "domain": F.lit(""), "contact_name": F.lit(public["contact"]),
        "phone": F.when(phone == "", "-").otherwise(phone),
        "notes": strip(F.concat(F.lit(public["note"]), strip(text_or_empty("notes")))),
        "selected_products": F.array(F.lit(public["product"])),
        "geo_score": F.lit(None).cast("double"), "ai_cited": F.lit(False),
    }
    return fixed.get(name, F.col(name))


def append_leads(leads: DataFrame, path: str, now: Column, public: dict[str, str] = K.PUBLIC_LEAD) -> None:
    """Accepted and rejected leads go to their own folders."""
    prepared = prepare_leads(leads, now, public)
    accepted = prepared.where(F.col("reject_reason").isNull()).drop("reject_reason")
    with_day(accepted, "submitted_at").write.mode("append").partitionBy("day").parquet(f"{path}/accepted")
    prepared.where(F.col("reject_reason").isNotNull()).write.mode("append").parquet(f"{path}/rejected")


def write_reports(public: DataFrame, private: DataFrame, path: str) -> None:
    """Two outputs, never one with a filter on top."""
    public.write.mode("overwrite").parquet(f"{path}/public")
    private.write.mode("overwrite").parquet(f"{path}/private")
