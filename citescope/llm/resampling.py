"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their words.

Hashed word counts of all documents and of the target give one gain per bucket; the gains are an array of fixed length, and
a document's weight is the sum of the array at its words' buckets. A Gumbel draw fixed by the document id is added, and the
highest scores are taken without replacement.

Exact ranks come from parallel sorting by regular sampling. Every partition is sorted by itself, a run; each run gives
samples at equal distances, and their order gives the splitters of equally large segments. Only segments within the draw are
exchanged, each is sorted by itself, and the counts of the segments before it make its ranks exact. The order ends with a
number unique to the row, so rows that tie in score and id are split like any others.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

BUCKETS = 10_000
#: Rows of a segment that one task sorts; the number of segments follows the table.
SEGMENT_ROWS = 1_000_000
#: Samples per run or segment, whichever are more.
SAMPLES = 16
#: Remembered words per task.
MEMORY = 1 << 20

_LAST = (1 << 63) - 1
SCORED = "doc_id long, n_features long, weight long, score long, eligible boolean, falling long, ordinal long, row long"


def _separators() -> bytes:
    """All bytes that stand in no word become spaces and A-Z become a-z; bytes from 0x80 on belong to words."""
    kept = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
    return bytes(b if b in kept else b + 32 if chr(b).isupper() and b < 0x80 else 0x20 for b in range(256))


_WORDS = _separators()


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII digits and letters, lower case, and of all characters beyond ASCII; none for a missing text."""
    return (text or "").encode().translate(_WORDS).split()


class _Buckets(dict):
    """Bucket of a feature; remembers up to MEMORY features."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self._buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self._buckets
        return found


def _features(text: str | None, n: int) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to n words."""
    found = words(text)
    runs = list(found)
    for k in range(2, n + 1):
        runs += [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
    return len(found), runs


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows. A task sums its rows first, so at most `buckets` rows leave it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                _, runs = _features(text, n)
                total += np.bincount(np.fromiter(map(of.__getitem__, runs), np.int64, len(runs)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    partial = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to source, rounded down."""
    buckets = len(source)
    s, t = int(source.sum()) + buckets, int(target.sum()) + buckets
    return np.array(
        [math.floor(1000 * math.log(float((int(b) + 1) * s) / float((int(a) + 1) * t))) for a, b in zip(source, target, strict=True)],
        np.int64,
    )


def _gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, n: int, least_words: int, seed: int) -> DataFrame:
    """Weight, score and place in the order (falling, ordinal, row) of every row; `row` is unique."""
    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        nonlocal seen
        ids, weights, counts, enough = batch["doc_id"].to_pylist(), [], [], []
        for text in batch["text"].to_pylist():
            size, runs = _features(text, n)
            weights.append(int(gain[np.fromiter(map(of.__getitem__, runs), np.int64, len(runs))].sum()))
            counts.append(len(runs))
            enough.append(size >= least_words)
        score = [w + _gumbel(d, seed) for w, d in zip(weights, ids, strict=True)]
        first = (TaskContext.get().partitionId() << 40) + seen
        seen += len(ids)
        yield {
            "doc_id": ids, "n_features": counts, "weight": weights, "score": score, "eligible": enough,
            "falling": [-s for s in score], "ordinal": [_LAST if d is None else d for d in ids],
            "row": list(range(first, first + len(ids))),
        }

    seen, of = 0, _Buckets(len(gain))
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), per_batch, SCORED)


ORDER = ["falling", "ordinal", "row"]


def _splitters(rows: DataFrame, segments: int, step: int) -> list[tuple[int, int, int]]:
    """Upper ends of all segments but the last: every run gives each `step`-th row of its order with its number of rows."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, out = None, 0, []
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ORDER), strict=True))
            # The middle row of every stretch stands for it.
            for i in range((step // 2 - seen) % step, len(keys), step):
                out.append((*keys[i], step))
            held, seen = keys[-1] if keys else held, seen + len(keys)
        if held is not None and not out:
            out.append((*held, seen))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=[*ORDER, "n"])

    found = rows.select(ORDER).sortWithinPartitions(*ORDER).mapInArrow(sample, "falling long, ordinal long, row long, n long")
    samples = sorted(tuple(r) for r in found.collect())
    sums = list(accumulate(s[3] for s in samples))
    total = sums[-1] if sums else 0
    at = sorted({bisect_right(sums, total * k // segments) for k in range(1, segments)})
    return [samples[i][:3] for i in at if i < len(samples)]


def _with_segment(rows: DataFrame, splitters: list[tuple[int, int, int]]) -> DataFrame:
    first = np.array([s[0] for s in splitters], np.int64)

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        falling = batch["falling"].to_numpy()
        low, high = np.searchsorted(first, falling, "left"), np.searchsorted(first, falling, "right")
        segment = low.copy()
        for i in np.flatnonzero(low < high).tolist():  # a splitter has this score: the whole key decides
            key = tuple(batch[c][i].as_py() for c in ORDER)
            while segment[i] < high[i] and splitters[segment[i]] < key:
                segment[i] += 1
        yield {c: batch[c] for c in batch.schema.names} | {"segment": pa.array(segment, pa.int64())}

    return map_rows(rows, per_batch, f"{SCORED}, segment long")


def ranked(rows: DataFrame, draw: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """`rows` (columns of SCORED, a stored table) with `rank` 1 to `draw` in ORDER among eligible rows, NULL for the rest."""
    pool = rows.where("eligible")
    total = pool.count()
    if not total or not draw:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    runs = pool.rdd.getNumPartitions()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    segments = max(cores, -(-total // segment_rows))
    step = max(1, total // (SAMPLES * max(segments, runs)))
    cut = stored(_with_segment(rows, _splitters(pool, segments, step)))
    counts = {r["segment"]: r["n"] for r in cut.where("eligible").groupBy("segment").agg(F.count("*").alias("n")).collect()}
    before = dict(zip(sorted(counts), accumulate((counts[s] for s in sorted(counts)), initial=0), strict=False))
    inside = [(s, n) for s, n in before.items() if n < draw]
    offsets = rows.sparkSession.createDataFrame(inside, "segment long, _before long")
    last = max(s for s, _ in inside)
    drawn = F.col("eligible") & (F.col("segment") <= last)
    numbered = cut.where(drawn).withColumn("_no", F.row_number().over(Window.partitionBy("segment").orderBy(*ORDER)))
    rank = (F.col("_no") + F.col("_before")).cast("long")
    taken = numbered.join(offsets, "segment").withColumn("rank", F.when(rank <= draw, rank)).drop("_no", "_before")
    return taken.unionByName(cut.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = BUCKETS, least_words: int = 20,
    seed: int = 2024, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (NULL if it isn't drawn).

    Of the documents with at least `least_words` words, `percent` percent (rounded down) with the highest scores are drawn;
    ties go to the smaller doc_id, rows without doc_id come last and draw from the seed alone. Repeated rows each count
    and are ranked one after the other. A missing text has no features, as has an empty one. Empty tables give no rows; an
    empty target makes all its counts zero. Other columns are ignored. The driver holds the bucket arrays (`buckets` numbers)
    and a few samples per run and segment.
    """
    source, wanted = bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets)
    rows = stored(scored(docs, gains(source, wanted), n, least_words, seed))
    draw = rows.where("eligible").count() * percent // 100
    return ranked(rows, draw, segment_rows).select("doc_id", "n_features", "weight", "score", "rank")
