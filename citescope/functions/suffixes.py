"""C1, C2 with a rule file: public suffixes with wildcard and exception rules, and international host names.

The rule file has the form of the Public Suffix List: a rule per line, `*.x` for every label below x, `!y.x` for the
exception of one, `//` for comments. A host belongs to the exception that matches, else to the rule with most labels, else
to its last label. Rules and hosts are compared in ASCII form, so `한국` and `xn--3e0b707e` are one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .urls import url_host

_PRIVATE = r"(?s)// ===BEGIN PRIVATE DOMAINS===.*?(?:// ===END PRIVATE DOMAINS===|$)"


def _ascii(host: str | None) -> str | None:
    if host is None or host.isascii():
        return host
    try:
        return ".".join(label.encode("idna").decode() if label else "" for label in host.split("."))
    except UnicodeError:
        return host


def _unicode(host: str | None) -> str | None:
    def label(part: str) -> str:
        try:
            return part.encode().decode("idna") if part.startswith("xn--") else part
        except UnicodeError:
            return part

    return None if host is None else ".".join(label(p) for p in host.split("."))


@F.pandas_udf(StringType())
def ascii_host(hosts: pd.Series) -> pd.Series:
    """Punycode form; a label that has none stays as it is."""
    return hosts.map(_ascii)


@F.pandas_udf(StringType())
def unicode_host(hosts: pd.Series) -> pd.Series:
    """Readable form: labels `xn--...` decoded, where they can be."""
    return hosts.map(_unicode)


def _only_where(hosts: DataFrame, test: Column, name: str, change) -> DataFrame:
    """`change` for the rows of `test`; the others never enter a Python worker."""
    odd = hosts.where(test).withColumn(name, change(F.col(name)))
    return hosts.where(~test).unionByName(odd)


def suffix_rules(lines: DataFrame) -> DataFrame:
    """Column `value` with one rule per row -> (key, labels, exception): how many labels of a host with this ending are its suffix."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    rules = lines.select(rule.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    plain = rules.select(
        F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("key"), F.col("rule").startswith("*.").alias("_any"),
        F.col("rule").startswith("!").alias("exception"),
    )
    coded = _only_where(plain, F.col("key").rlike(r"[^\x00-\x7F]"), "key", ascii_host)
    size = F.size(F.split("key", r"\."))
    labels = size + F.when(F.col("_any"), 1).when(F.col("exception"), -1).otherwise(0)
    return coded.select("key", labels.alias("labels"), "exception").distinct()


def read_suffix_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """The rules of a file; the section of private domains only with `private`."""
    text = spark.read.text(path, wholetext=True)
    kept = F.col("value") if private else F.regexp_replace("value", _PRIVATE, "")
    return suffix_rules(text.select(F.explode(F.split(kept, r"\r?\n")).alias("value")))


def host_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, domain) for distinct hosts: their registrable domain in ASCII form.

    Addresses, single labels and hosts that are a suffix themselves stay as they are, without a leading `www.`. Rules
    are broadcast where Spark measures them as small; otherwise AQE splits the hosts of a common ending.
    """
    coded = _only_where(
        hosts.select("host", F.col("host").alias("_name")), F.coalesce(F.col("host").rlike(r"[^\x00-\x7F]"), F.lit(False)), "_name", ascii_host
    )
    parts = F.split("_name", r"\.")
    n = F.size("_parts")
    endings = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("_parts", i, n), "."))
    address = F.col("_name").rlike(r"^[0-9.]+$|[:\[]")
    asked = coded.withColumn("_parts", parts).withColumn("_key", F.explode(F.when(address, F.array(F.lit(""))).otherwise(endings)))
    known = rules.withColumnRenamed("key", "_key")
    found = asked.join(known, "_key", "left").groupBy("host", "_name").agg(
        F.max(F.when(F.col("exception"), F.col("labels"))).alias("_exception"),
        F.max(F.when(F.col("labels") <= n, F.col("labels"))).alias("_labels"), F.first("_parts").alias("_parts"),
    )
    suffix = F.coalesce("_exception", "_labels", F.lit(1))
    whole = F.regexp_replace("_name", r"^www\.", "")
    domain = F.when(address | (n <= suffix), whole).otherwise(F.array_join(F.slice("_parts", n - suffix, suffix + 1), "."))
    return found.select("host", domain.alias("domain"))


def with_registrable_domain(df: DataFrame, url: str, rules: DataFrame, out: str = "domain", readable: bool = False) -> DataFrame:
    """C2 by rules: `out` is the eTLD+1 of `url`, '' for empty input; `readable` decodes international labels.

    Every distinct host is looked up once; rows meet their host's answer in a join that AQE splits where a host is busy.
    """
    rows = df.withColumn("_host", F.coalesce(url_host(url), F.lit("")))
    known = host_domains(rows.select(F.col("_host").alias("host")).distinct(), rules)
    if readable:
        known = _only_where(known, F.col("domain").contains("xn--"), "domain", unicode_host)
    renamed = known.select(F.col("host").alias("_host"), F.col("domain").alias(out))
    return rows.drop(out).join(renamed, "_host", "left").select(*[c for c in df.columns if c != out], out)
