"""Quality rules with DataFrame functions only: base rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import WORD, stored

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbol_share", "line_share", "repeat_share")
#: Smallest standard deviation per feature: what varies less is no evidence against a document.
FLOORS = (0.05, 0.05, 0.1, 0.1)
#: Median and 1 - 1e-9 quantile of chi-squared with 4 degrees of freedom.
CHI2_MEDIAN, CHI2_CUTOFF = 3.3567, 46.8


def _repeat_words(words: Column, size: int) -> Column:
    """Words covered by a window of `size` words that occurs twice or more. Only texts with equal windows are sorted."""

    def of_hashes(h: Column) -> Column:
        shifted = [F.slice(h, k + 1, F.greatest(F.size(h) - size + 1, F.lit(0))) for k in range(size)]
        windows = F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(w))

        def of_windows(w: Column) -> Column:
            ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def of_ordered(s: Column) -> Column:
                twin = F.filter(
                    s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"])
                )
                places = F.array_sort(F.transform(twin, lambda x: x["i"]))
                return let(places, lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1), x + size) - x)),
                    F.lit(0).cast("long"), lambda total, x: total + x,
                ))

            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(ordered, of_ordered))

        return F.when(F.size(h) <= size, F.lit(0).cast("long")).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def statistics(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, lang, source and the five counts of every whole text. A missing text is empty."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(F.col("_text"), F.lit(WORD), F.lit(0))
    wordy = F.filter(F.split("_text", "\n", -1), lambda line: F.length(F.translate(line, _WHITE, "")) > 0)
    dup_lines = let(wordy, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w, window).alias("r")))
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("_text")).select(
        "doc_id", "lang", "source", counts.alias("c"),
        F.length(F.translate("_text", _WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", F.col("c.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("c.r").alias("n_repeat_words"))


def features(rows: DataFrame) -> DataFrame:
    """The transformed statistics: logarithms of word length and symbols per word, roots of the shares of repeats.

    Short texts vary more for no other reason than their length; their values are drawn towards the usual ones
    (5 characters a word, nothing else) as if they had 20 more words.
    """
    n = F.col("n_words") + 20
    return rows.select(
        "*",
        F.log((F.col("word_chars") + 100) / n).alias("word_length"),
        F.log1p(F.col("n_symbols") / n).alias("symbol_share"),
        F.sqrt(F.col("n_dup_lines") / n * 10).alias("line_share"),
        F.sqrt(F.col("n_repeat_words") / n).alias("repeat_share"),
    )


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """`pool`: language and source if at least `least` rows share them, else the language's other rows, else all others; NULL if even these are few."""
    own = F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source"))
    wide = F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source"))
    rest = F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    counts = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    first = counts.withColumn("pool", F.when(F.col("n") >= least, own).otherwise(wide))
    sums = first.groupBy("pool").agg(F.sum("n").alias("pooled"))
    second = first.join(sums, "pool").withColumn("pool", F.when(F.col("pooled") >= least, F.col("pool")).otherwise(rest)).drop("pooled")
    sums = second.groupBy("pool").agg(F.sum("n").alias("pooled"))
    last = second.join(sums, "pool").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.when(F.col("pooled") >= least, F.col("pool")).alias("pool")
    )
    return rows.join(last, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source")


def _moments(rows: DataFrame) -> DataFrame:
    """Mean vector and covariance (lower triangle) per pool."""
    pairs = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[: i + 1]]
    sums = rows.groupBy("pool").agg(
        *[F.avg(a).alias(f"m_{a}") for a in FEATURES],
        *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs],
    )
    return sums.select("pool", *[f"m_{a}" for a in FEATURES], *[f"c_{a}_{b}" for a, b in pairs])


def _factored(moments: DataFrame) -> DataFrame:
    """Cholesky factor of the covariance with the variance floors added: l_i_j, one expression per entry."""
    out = moments
    for i, a in enumerate(FEATURES):
        for j in range(i + 1):
            value = F.col(f"c_{a}_{FEATURES[j]}") + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            entry = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", entry)
    return out


def _distances(rows: DataFrame, factored: DataFrame) -> DataFrame:
    """Add `d2`, the squared Mahalanobis distance to the row's pool, by forward substitution."""
    size = len(FEATURES)
    params = factored.select(
        F.col("pool").alias("_pool"), *[f"m_{a}" for a in FEATURES], *[f"l_{i}_{j}" for i in range(size) for j in range(i + 1)]
    )
    joined = rows.join(params, F.col("pool") == F.col("_pool"), "left")
    for i, a in enumerate(FEATURES):
        value = F.col(a) - F.col(f"m_{a}")
        for j in range(i):
            value = value - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        joined = joined.withColumn(f"z_{i}", value / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, size)), F.col("z_0") * F.col("z_0"))
    return joined.withColumn("d2", total).select(*rows.columns, "d2")


def outliers(rows: DataFrame, core: float = 0.75, steps: int = 4, least: int = 50) -> DataFrame:
    """Add `d2` to statistics: robust squared distance to the documents of the same language and source.

    Minimum covariance determinant: from the median and median deviation of every feature, each step takes the `core`
    share of a pool's rows that is nearest, and their mean and covariance (which never raises the determinant). The
    share is cut at an approximate percentile. Distances are rescaled if their median is above that of chi-squared.
    Rows of pools below `least` rows get NULL.
    """
    pooled = stored(_grouped(features(rows), least))
    medians = pooled.groupBy("pool").agg(*[F.percentile_approx(a, 0.5, 1000).alias(f"m_{a}") for a in FEATURES])
    centred = pooled.join(medians.withColumnRenamed("pool", "_pool"), F.col("pool") == F.col("_pool"))
    spread = centred.groupBy("pool").agg(
        *[F.first(f"m_{a}").alias(f"m_{a}") for a in FEATURES],
        *[F.pow(1.4826 * F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5, 1000), 2).alias(f"c_{a}_{a}") for a in FEATURES],
    )
    moments = spread.select(
        "*", *[F.lit(0.0).alias(f"c_{a}_{b}") for i, a in enumerate(FEATURES) for b in FEATURES[:i]]
    )
    for _ in range(steps):
        near = _distances(pooled, stored(_factored(moments)))
        cut = near.where("d2 is not null").groupBy("pool").agg(F.percentile_approx("d2", core, 1000).alias("cut"))
        inside = near.join(cut.withColumnRenamed("pool", "_pool"), F.col("pool") == F.col("_pool")).where("d2 <= cut")
        moments = _moments(inside)
    near = _distances(pooled, stored(_factored(moments)))
    middle = near.where("d2 is not null").groupBy("pool").agg(F.percentile_approx("d2", 0.5, 1000).alias("middle"))
    scaled = near.join(middle.withColumnRenamed("pool", "_pool"), F.col("pool") == F.col("_pool"), "left")
    return scaled.withColumn("d2", F.col("d2") / F.greatest(F.col("middle") / CHI2_MEDIAN, F.lit(1.0))).select(*rows.columns, "d2")


def rules(docs: DataFrame, cutoff: float = CHI2_CUTOFF, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """One row per input row: doc_id, the five counts, base_failed, d2 and kept.

    base_failed: fewer than `least_words` words, or over `most_repeated` percent of the words in repeated windows. Of the
    others, a document is kept unless its statistics lie beyond `cutoff` of its language and source; documents that
    fail the base rules don't shape the estimates. Pools that are too small to judge reject nothing (d2 NULL), nor do
    rows that failed before have a d2. NULL languages and sources are values like others; missing and empty texts fail
    the base rules; rows without doc_id are judged alike. An empty table gives an empty result.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = stored(statistics(docs).withColumn("base_failed", failed))
    judged = outliers(rows.where("not base_failed"))
    out = judged.withColumn("kept", F.coalesce(F.col("d2") <= cutoff, F.lit(True)))
    rest = rows.where("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return out.unionByName(rest).select("doc_id", *STATISTICS, "base_failed", "kept", "d2", "lang", "source")
