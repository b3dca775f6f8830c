"""Address scope: which hits come from public addresses. Ranges are fixed, so no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants as K
from .text import col, let, text_or_empty

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _v4_number(ip: Column) -> Column:
    parts = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    return parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]


def _range_of(address: str, bits: int) -> tuple[int, int]:
    low = 0
    for part in address.split("."):
        low = low * 256 + int(part)
    return low, low + (1 << (32 - bits)) - 1


def _v4_blocked(ip: Column) -> Column:
    ranges = [_range_of(a, b) for a, b in K.BLOCKED_V4]

    def test(n: Column) -> Column:
        hit = F.lit(False)
        for low, high in ranges:
            hit = hit | n.between(low, high)
        return hit

    return let(_v4_number(ip), test)


def _v6_groups(ip: Column) -> Column:
    """The groups of an IPv6 text, with a dotted tail turned into two groups."""
    tail = F.regexp_extract(ip, rf"({_V4})$", 1)
    number = F.when(tail != "", _v4_number(tail))
    groups = F.concat(
        F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"),
        F.lower(F.hex(number.bitwiseAND(65535))),
    )
    return F.when(tail != "", F.concat(F.regexp_replace(ip, rf"{_V4}$", ""), groups)).otherwise(ip)


def _v6_hex(ip: Column) -> Column:
    """32 hex digits, NULL if the text is not an IPv6 address."""
    full = _v6_groups(F.lower(ip))

    def expand(text: Column) -> Column:
        halves = F.split(text, "::", -1)
        left = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda g: g != "")
        right = F.filter(F.split(text_or_empty(F.get(halves, F.lit(1))), ":"), lambda g: g != "")
        missing = F.lit(8) - F.size(left) - F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        groups = F.when(F.size(halves) == 1, left).otherwise(F.concat(left, zeros, right))
        squeezed = F.size(halves) == 2
        shape = text.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::)?(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$")
        valid = shape & (
            (squeezed & (missing >= 1)) | (~squeezed & (F.size(left) == 8))
        )
        return F.when(
            valid, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
        )

    return let(full, expand)


def ip_scope(ip: Column | str) -> Column:
    """public, blocked-range-v4, blocked-range-v6, ipv4-mapped-v6-hex or invalid-ip."""
    def of_v6(raw: Column) -> Column:
        return let(
            _v6_hex(raw),
            lambda v6: F.when(v6.isNull(), "invalid-ip")
            .when(raw.rlike(r"(?i)^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), "ipv4-mapped-v6-hex")
            .when(v6.rlike(K.BLOCKED_V6_HEX), "blocked-range-v6")
            .otherwise("public"),
        )

    def of_text(raw: Column) -> Column:
        # An IPv4 address, plain or mapped into IPv6, is judged by the IPv4 ranges.
        return let(
            F.regexp_extract(raw, rf"(?i)^(?:::ffff:)?({_V4})$", 1),
            lambda v4: F.when(v4 == "", of_v6(raw)).when(_v4_blocked(v4), "blocked-range-v4").otherwise("public"),
        )

    return let(text_or_empty(ip), of_text)


def public_only(df: DataFrame, ip: str) -> DataFrame:
    """Drop hits from internal, reserved and malformed addresses."""
    return df.where(ip_scope(col(ip)) == "public")
