"""Personal data: fixed patterns, then neighbouring terms that reveal a protected value by corpus co-occurrence."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

BASE = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits: if the run's start fails, so does every later place in it.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = " .,!?;:()[]{}<>*#$%&|\"'“”„«»‹›‘’—–-"
#: Bits of the filter that terms pass before they are counted; its size is fixed, whatever the corpus.
_FILTER_BITS = 1 << 22


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, without trying every start inside a long run of characters."""
    out, at = [], 0
    mark = text.find("@")
    while mark >= 0:
        start = mark
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, mark + 1) if start < mark else None
        if found:
            out.append((start, found.end()))
            at = found.end()
        mark = text.find("@", max(mark + 1, at))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind in code points, leftmost and non-overlapping; matches that fail their check are dropped."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 2 or len(p.lstrip("0")) == 3 and int(p) <= 255 for p in m[0].split("."))]
    cards, phones = [], []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    if "+" in text:
        phones = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return {"email": _emails(text), "ip": ips, "card": cards, "phone": phones}


def joined_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def normal(word: str) -> str:
    return word.lower().strip(_EDGE)[:64]


def _value(kind: str, found: str) -> int:
    plain = found.lower() if kind in ("email", "ip") else "".join(c for c in found if c.isdigit())
    return xxhash.xxh64_intdigest(f"{kind}:{plain}", 1) - (1 << 63)


def near_terms(text: str, spans: dict[str, list[tuple[int, int]]], reach: int) -> list[tuple[int, str, int, int]]:
    """(value, term, start, end) of the words within `reach` words of a protected value that aren't part of one."""
    taken = sorted(s for own in spans.values() for s in own)
    if not taken:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    hit = np.zeros(len(words), bool)
    ranges = {}
    for a, b in taken:
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, b - 1, "right")) - 1
        hit[max(first, 0) : last + 1] = True
        ranges[a, b] = max(first, 0), last
    out = []
    for kind, own in spans.items():
        for a, b in own:
            first, last = ranges[a, b]
            value = _value(kind, text[a:b])
            for i in (*range(max(0, first - reach), first), *range(last + 1, min(len(words), last + 1 + reach))):
                if not hit[i]:
                    term = normal(text[words[i][0] : words[i][1]])
                    if len(term) >= 3:
                        out.append((value, term, *words[i]))
    return out


def find_base(docs: DataFrame, reach: int = 5) -> DataFrame:
    """(row, doc_id, counts, base, near) of every whole text: base spans and the terms near them. Stored."""
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long"), "text")

    def per_batch(batch):
        out = {k: [] for k in ("base", "near", *(f"n_{k}" for k in BASE))}
        for text in batch.column(2).to_pylist():
            text = text or ""
            spans = base_spans(text)
            out["base"].append(joined_spans([(k, *s) for k in BASE for s in spans[k]]))
            for k in BASE:
                out[f"n_{k}"].append(len(spans[k]))
            out["near"].append([dict(zip(("value", "term", "start", "stop"), n, strict=True)) for n in near_terms(text, spans, reach)])
        yield {"row": batch.column(0), "doc_id": batch.column(1)} | out

    counts = ", ".join(f"n_{k} long" for k in BASE)
    schema = f"row long, doc_id long, {counts}, base string, near array<struct<value: long, term: string, start: int, stop: int>>"
    return stored(map_rows(keyed, per_batch, schema))


def _bit(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(_FILTER_BITS))


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): documents with each of `terms`, over all documents.

    Words are checked against a bit filter of fixed size first, so only few of them are counted; the join decides.
    """
    words64 = terms.select(_bit(F.col("term")).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")
    )
    bits = np.zeros(_FILTER_BITS // 64, np.int64)
    for r in words64.toLocalIterator():
        bits[r["at"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    class Known(dict):
        def __missing__(self, raw):
            if len(self) > 1 << 18:
                self.clear()
            term = normal(raw)
            at = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)
            at = (at - (1 << 64) if at >> 63 else at) % _FILTER_BITS
            value = self[raw] = term if int(self.bits[at >> 6]) >> (at & 63) & 1 else None
            return value

    def per_batch(batch):
        known = Known()
        known.bits = shared.value
        found: dict[str, int] = {}
        for text in batch.column(0).to_pylist():
            for term in {known[w] for w in set((text or "").split())}:
                if term:
                    found[term] = found.get(term, 0) + 1
        yield {"term": list(found), "n": list(found.values())}

    counted = map_rows(docs.select("text"), per_batch, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted.join(terms, "term", "left_semi")


def disclosing(found: DataFrame, docs: DataFrame, threshold: float = 0.8, remove_at: float = 0.95, least: int = 3) -> DataFrame:
    """(value, term, action): terms that give a protected value away.

    With documents as events, PMI(term, value) = log(N * n_both / (n_term * n_value)) is what the term tells about
    the value, of at most IC(value) = log(N / n_value). Terms that tell `threshold` of it are generalised, those that
    tell `remove_at` are removed. Pairs seen in fewer than `least` documents are no evidence.
    """
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.value", "x.term").distinct()
    total = found.count()
    both = near.groupBy("value", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= least)
    both = stored(both)
    values = near.select("row", "value").distinct().groupBy("value").agg(F.count("*").alias("n_value"))
    terms = document_counts(docs, both.select("term").distinct())
    told = F.log(F.lit(float(max(total, 1))) * F.col("n_both") / (F.greatest("n", "n_both") * F.col("n_value")))
    whole = F.log(F.lit(float(max(total, 1))) / F.col("n_value"))
    ratio = both.join(values, "value").join(terms, "term").withColumn("share", F.when(whole > 0, told / whole))
    action = F.when(F.col("share") >= remove_at, "remove").otherwise("generalise")
    return ratio.where(F.col("share") >= threshold).select("value", "term", action.alias("action"))


def spans(docs: DataFrame, threshold: float = 0.8, reach: int = 5) -> DataFrame:
    """Personal data in every whole text, as spans in code points.

    One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base (the base spans `kind:start:end`, by kind, then
    start), spans (base spans, then `generalise` and `remove` spans of the method), n_terms. The method's terms stand
    within `reach` words of a protected value that they disclose (see `disclosing`); a term is never part of a base
    span. Missing and empty texts have no spans. Rows that repeat a doc_id and text count once as evidence. A missing
    doc_id stays missing. An empty table gives an empty result; other columns are ignored.
    """
    found = find_base(docs, reach)
    revealing = disclosing(found, docs, threshold)
    marked = (
        found.select("row", F.explode("near").alias("x"))
        .select("row", "x.value", "x.term", "x.start", "x.stop")
        .join(revealing, ["value", "term"])
        .groupBy("row", "start", "stop").agg(F.max("action").alias("action"))
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("action", "start", "stop"))).alias("terms"))
    )
    texts = F.transform(F.coalesce("terms", F.array().cast("array<struct<action:string,start:int,stop:int>>")), lambda t: F.concat_ws(":", t["action"], t["start"], t["stop"]))
    every = F.array_join(F.filter(F.concat(F.array("base"), texts), lambda s: s != ""), ",")
    return found.drop("near").join(marked, "row", "left").select(
        "row", "doc_id", *[f"n_{k}" for k in BASE], "base", every.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"),
    )


def sanitised(docs: DataFrame, threshold: float = 0.8, reach: int = 5) -> DataFrame:
    """The documents with base spans replaced by their kind, generalised terms by their shape, removed terms by nothing."""
    marks = spans(docs, threshold, reach).select("row", "spans").dropDuplicates(["row"])
    named = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), "text"))

    @F.pandas_udf("string")
    def replaced(texts, marks_):
        import pandas as pd

        return pd.Series([apply_spans(t, m) for t, m in zip(texts, marks_, strict=True)])

    joined = named.join(marks, named["_row"] == marks["row"])
    text = F.when(F.col("spans") == "", F.col("text")).otherwise(replaced("text", "spans"))
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def apply_spans(text: str | None, marks: str | None) -> str | None:
    if not text or not marks:
        return text
    out, at = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (m.split(":") for m in marks.split(","))):
        a = max(a, at)
        if b <= at:
            continue
        shape = "[NUMBER]" if any(c.isdigit() for c in text[a:b]) else "[NAME]" if text[a : a + 1].isupper() else "[TERM]"
        out += [text[at:a], "" if kind == "remove" else shape if kind == "generalise" else f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]
