"""Removal of passages that repeat across documents: windows repeated at one length alone are doubled."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored, words

_ODD = 0x9E3779B97F4A7C15
#: Different words whose hashes a task remembers.
_REMEMBERED = 1 << 19
#: Keys with over one part in so many of all rows are joined by broadcast; there can't be more of them than that.
_HOT = 1000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every `size` consecutive words, from the words' hashes (uint64)."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    inverse = pow(_ODD, -1, 1 << 64)
    with np.errstate(over="ignore"):
        rising = np.cumprod(np.full(n, _ODD, np.uint64))
        falling = np.cumprod(np.full(n, inverse, np.uint64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * rising)))
        return _mixed((sums[size:] - sums[:-size]) * falling[: n - size + 1])


def _second(hashes: np.ndarray, size: int) -> np.ndarray:
    """32 more bits for every window, from the words' hashes mixed once more: equal windows are told by 96 bits."""
    return (window_hashes(_mixed(hashes ^ np.uint64(_ODD)), size) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(half: np.ndarray, window: int) -> np.ndarray:
    """For every window start, the position of the smallest half window inside it (the leftmost of equal ones).

    Equal windows choose the half window at the same place, so a window can only repeat if its anchor does.
    """
    inside = window - window // 2 + 1
    if len(half) < inside:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(half, inside)
    step = 1 << 20
    chosen = [view[a : a + step].argmin(axis=1) for a in range(0, len(view), step)]
    return np.concatenate(chosen) + np.arange(len(view))


def _hashes(tokens: list[bytes], known: _WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def _keyed(docs: DataFrame) -> DataFrame:
    """`row` names a row by its content, so rows that repeat a doc_id with another text stay apart."""
    id_ = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(id_, "text").alias("row"), id_.alias("doc_id"), "text")


def _copies(keyed: DataFrame) -> DataFrame:
    """(row, copy): rows whose whole text stands in a smaller doc_id. All their windows repeat; they need no search."""
    hashed = keyed.select("row", "doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"))
    first = hashed.groupBy("a", "b").agg(F.min("doc_id").alias("first_doc"))
    later = hashed.join(first, ["a", "b"]).where("doc_id > first_doc")
    return later.select("row").distinct().withColumn("copy", F.lit(True))


def _anchor_rows(texts: DataFrame, window: int) -> DataFrame:
    """One row per anchor: the hash of its half window, and the windows it stands for, `n` starts from `start` on."""

    def per_batch(batch):
        known = _WordHashes()
        for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch, "packed"), strict=True):
            tokens = words(text)
            if len(tokens) < window:
                continue
            half = window_hashes(_hashes(tokens, known), window // 2)
            # Anchors never step back, so the windows of one are neighbours.
            at, start, n = np.unique(anchors(half, window), return_index=True, return_counts=True)
            yield {
                "row": np.full(len(at), row), "doc_id": [doc] * len(at), "start": start.astype(np.int32),
                "n": n.astype(np.int32), "half": half[at].view(np.int64),
            }

    return map_rows(texts.select("row", "doc_id", "packed"), per_batch, "row long, doc_id long, start int, n int, half long")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts, compressed for their one shuffle."""
    import zstandard

    def per_batch(batch):
        press = zstandard.ZstdCompressor(level=1)
        texts = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        yield {"row": batch.column(0), "doc_id": batch.column(1), "packed": texts}

    return map_rows(docs, per_batch, "row long, doc_id long, packed binary")


def _unpacked(batch, name: str):
    import zstandard

    press = zstandard.ZstdDecompressor()
    for packed in batch.column(batch.schema.get_field_index(name)).to_pylist():
        yield press.decompress(packed).decode("utf-8", "surrogatepass")


def _window_rows(candidates: DataFrame, window: int) -> DataFrame:
    """Windows whose anchor repeats: the candidates at the doubled length. Only their words are hashed again."""

    def per_batch(batch):
        known = _WordHashes()
        columns = (batch.column(k).to_pylist() for k in (0, 1, 3))
        for row, doc, runs, text in zip(*columns, _unpacked(batch, "packed"), strict=True):
            tokens = words(text)
            # Neighbouring runs of starts are joined; the words they cover are laid end to end.
            joined: list[list[int]] = []
            for start, n in sorted((r["start"], r["n"]) for r in runs):
                if joined and joined[-1][1] == start:
                    joined[-1][1] += n
                else:
                    joined.append([start, start + n])
            covered, starts, places = [], [], []
            for a, b in joined:
                starts.append(np.arange(a, b, dtype=np.int32))
                places.append(np.arange(len(covered), len(covered) + b - a))
                covered += tokens[a : b + window - 1]
            hashes, place = _hashes(covered, known), np.concatenate(places)
            yield {
                "row": np.full(len(place), row), "doc_id": [doc] * len(place), "start": np.concatenate(starts),
                "full": window_hashes(hashes, window)[place].view(np.int64), "more": _second(hashes, window)[place],
            }

    return map_rows(
        candidates.select("row", "doc_id", "packed", "runs"), per_batch, "row long, doc_id long, start int, full long, more int"
    )


def _in_several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in two documents at least, with the smallest of them (first_doc). `rows` are stored.

    Keys are summed up before the shuffle. At most _HOT keys can hold over one part in _HOT of all rows each; these go to all
    tasks by a broadcast that never exceeds _HOT rows, so no task of the join gets such a key as a whole.
    """
    ends = rows.groupBy(*keys).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("times"))
    ends = stored(ends.where("first_doc < last_doc").drop("last_doc"))
    hot = ends.where(F.col("times") * _HOT > rows.count()).drop("times")
    rest = ends.where(F.col("times") * _HOT <= rows.count()).drop("times")
    spread = rows.join(F.broadcast(hot), keys)
    return spread.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(rest, keys))


def repeated_windows(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """(texts, windows): texts as (row, doc_id, packed, copy), windows (row, start) that also start in a smaller doc_id.

    Whole copies of a smaller doc_id (`copy`) stand aside: what repeats in them repeats in that document. Texts are stored
    once, compressed, and are read from there at every level. Level 1 takes half windows (`window // 2` words), one per window: the anchor all equal windows agree on. Those in
    one document alone are done. Level 2 doubles the rest: only windows around a repeated half window are compared as
    a whole. A longer repeat consists of repeated windows, so no level above `window` could remove more. Level 1 compares
    64-bit hashes, level 2, which decides, 96 bits. Hot passages are summed up before they are shuffled and spread over tasks.
    """
    keyed = _keyed(docs)
    texts = stored(_packed(keyed).join(_copies(keyed), "row", "left"))
    single = texts.where("copy is null")
    halves = stored(_anchor_rows(single, window))
    alive = _in_several(halves, ["half"])
    runs = alive.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    windows = stored(_window_rows(single.join(runs, "row"), window))
    again = _in_several(windows, ["full", "more"]).where("doc_id > first_doc").select("row", "start")
    return texts, again


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Remove every word covered by a window whose word sequence also starts in a document with a smaller doc_id.

    Returns one row per input row: doc_id, n_words, n_removed, kept (the other words, joined by one space). Windows
    are judged on the input. Texts shorter than a window, empty and missing texts keep all their words. A row without
    doc_id is neither smaller nor larger than another: it keeps all its words and removes none elsewhere. Rows that
    repeat a doc_id don't remove each other. Other columns are ignored; an empty table gives an empty result.
    """
    texts, again = repeated_windows(docs, window)
    starts = again.groupBy("row").agg(F.collect_set("start").alias("starts"))

    def per_batch(batch):
        ids, kept, n_words, n_removed = batch.column(0), [], [], []
        columns = (batch.column(k).to_pylist() for k in (2, 3))
        for starts_, copy, text in zip(*columns, _unpacked(batch, "packed"), strict=True):
            tokens = words(text)
            if copy and len(tokens) >= window:
                left = []
            elif starts_:
                edges = np.zeros(len(tokens) + 1, np.int32)
                at = np.array(starts_)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
                stay = np.cumsum(edges[:-1]) == 0
                left = [w for w, s in zip(tokens, stay.tolist(), strict=True) if s]
            else:
                left = tokens
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            n_words.append(len(tokens))
            n_removed.append(len(tokens) - len(left))
        yield {"doc_id": ids, "n_words": n_words, "n_removed": n_removed, "kept": kept}

    joined = texts.join(starts, "row", "left").select("doc_id", "packed", "starts", "copy")
    return map_rows(joined, per_batch, "doc_id long, n_words long, n_removed long, kept string")
