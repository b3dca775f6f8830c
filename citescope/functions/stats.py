"""Rates and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import col


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as double, NULL if whole is 0."""
    return F.when(col(whole) != 0, col(part).cast("double") / col(whole))


def one_decimal(value: Column | str) -> Column:
    """A non-negative double with one digit after the point, rounded by its exact binary value, halves up.

    `format_string` rounds the shortest digits that name the double instead: 143.45 is a little less than it reads.
    """
    whole = F.floor(col(value))
    # Both scalings are by powers of two, so nothing is lost that could reach a half.
    part = ((col(value) - whole) * float(1 << 58)).cast("bigint")
    tenths = F.shiftright(part * 10 + (1 << 57), 58)
    return F.concat((whole + F.when(tenths == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def wilson(hits: Column | str, runs: Column | str, z: float = K.WILSON_Z) -> Column:
    """Wilson score interval as struct<low, high>, three digits; NULL without runs."""
    n = col(runs).cast("double")
    p = F.when(n != 0, col(hits) / n)
    z2 = z * z
    denominator = 1 + F.when(n != 0, z2 / n)
    center = (p + F.when(n != 0, z2 / (2 * n))) / denominator
    margin = z * F.sqrt(F.when(n != 0, (p * (1 - p) + z2 / (4 * n)) / n)) / denominator
    return F.when(
        n > 0,
        F.struct(
            F.greatest(F.lit(0.0), F.round(center - margin, 3)).alias("low"),
            F.least(F.lit(1.0), F.round(center + margin, 3)).alias("high"),
        ),
    )
