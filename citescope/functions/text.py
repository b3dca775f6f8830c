"""Text and array helpers built from native Spark functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers see it; Java's \s is ASCII only.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_space(pattern: str) -> str:
    """Widen every `\\s` of a pattern, outside and inside character classes, to Unicode space."""
    inner = WS[1:-1].replace(r"\s", r"\x20\t\n\x0b\f\r")
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(inner if in_class else f"[{inner}]")
            i += 2
            continue
        if two.startswith("\\"):
            out.append(two)
            i += 2
            continue
        if two[0] == "[":
            in_class = True
        elif two[0] == "]":
            in_class = False
        out.append(two[0])
        i += 1
    return "".join(out)


def one_of(words: Sequence[str]) -> str:
    """Alternation of literal words behind a look at the first character, which most text fails.

    Hangul counts as one range: a class of many single characters would be slower than the words.
    """
    latin = "".join(sorted({w[0] for w in words if w[0] < "가"}))
    hangul = "가-힣" if any(w[0] >= "가" for w in words) else ""
    return f"(?=[{hangul}{latin}])(?:{'|'.join(words)})"


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one blank; none at either end."""
    return F.trim(F.regexp_replace(col(c), WS + "+", " "))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times, also inside lambdas of `body`.

    A plain alias may be inlined by the optimizer, which would evaluate it again per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def host_in(host: Column, names: Sequence[str]) -> Column:
    """`host` is one of `names` or below one of them."""
    alternatives = "|".join(n.replace(".", r"\.") for n in names)
    return host.rlike(rf"(?i)(?:^|\.)(?:{alternatives})$")


def first_or_null(array: Column) -> Column:
    return F.get(array, F.lit(0))


def no_nulls(*values: Column) -> Column:
    return F.array_compact(F.array(*values))
