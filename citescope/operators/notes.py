"""Curated notes, benchmarks and feed candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ordered import top_k
from ..functions.text import text_or_empty


def valid_notes(notes: DataFrame) -> DataFrame:
    """M9: title, summary and an http(s) URL are required; confidence is high or medium."""
    confidence = F.when(F.col("confidence").isin("high", "medium"), F.col("confidence")).otherwise("medium")
    keep = (text_or_empty("title") != "") & (text_or_empty("summary") != "") & text_or_empty("url").rlike("(?i)^https?://")
    return notes.where(keep).withColumns({
        "kind": F.lit("fieldnote"), "source": text_or_empty("source"), "date": text_or_empty("date"),
        "client_action": text_or_empty("client_action"), "confidence": confidence,
    })


def valid_benchmarks(benchmarks: DataFrame) -> DataFrame:
    """M9: label and metric are required."""
    keep = (text_or_empty("label") != "") & (text_or_empty("metric") != "")
    return benchmarks.where(keep).withColumns({
        "kind": F.lit("benchmark"), "as_of": text_or_empty("as_of"), "note": text_or_empty("note"),
        "sample_note": text_or_empty("sample_note"),
    })


def feed_candidates(
    items: DataFrame, feed: Sequence[str] = ("feed",), order: Sequence[Column] | None = None,
    keywords: str = K.NEWS_KEYWORDS, k: int = K.NEWS_PER_FEED,
) -> DataFrame:
    """The first k items per feed whose title names the topic, file by file where the items have one."""
    hits = items.where(F.col("title").rlike(keywords))
    place = [F.col(c).asc() for c in ("file", "item_no") if c in items.columns]
    return top_k(hits, feed, order or place, k, "candidate_no")
