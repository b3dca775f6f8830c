"""Fill-in-middle: prefix, middle and suffix of every document, cut at line borders and moved round sentinels.

Line counts come from content-defined chunks. A rolling hash over the last 32 bytes places the chunk borders, so passages
that documents share fall into equal chunks wherever they stand. A task remembers the summary of a chunk under its whole
content (a lookup compares the bytes, not only their hash): code points, ends of lines, and the two bytes at either border,
in which a sentinel may continue from one chunk to the next. Sums of the summaries say which chunk holds a cut; only that
chunk is searched.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
_OPEN = b"<"
_MARKS = tuple(s.encode() for s in SENTINELS.values())

#: Chunks have 64 to 4096 bytes, about 600 on average. A shorter text is one chunk.
_LEAST, _MOST, _MASK = 64, 4096, np.uint32(0x1FF << 20)
#: Bytes of remembered chunks per task; beyond it the oldest half goes, which costs time, never a result.
MEMORY = 64 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _byte_codes() -> np.ndarray:
    """256 fixed 32-bit codes, one per byte value."""
    return np.array([int.from_bytes(hashlib.sha256(b"%d" % i).digest()[:4], "little") for i in range(256)], dtype=np.uint32)


_CODES = _byte_codes()


def chunk_ends(data: bytes) -> list[int]:
    """Where chunks end. Inside the window every byte's code is shifted by its age, so after 32 bytes it has left the hash."""
    n = len(data)
    if n <= _LEAST:
        return [n] if n else []
    rolled = _CODES[np.frombuffer(data, dtype=np.uint8)]
    span = 1
    while span < 32:
        rolled[span:] = rolled[span:] + (rolled[:-span] << np.uint32(span))
        span *= 2
    ends, last = [], 0
    for at in (np.flatnonzero(rolled & _MASK == 0) + 1).tolist():
        while at - last > _MOST:
            last += _MOST
            ends.append(last)
        if at - last >= _LEAST:
            ends.append(at)
            last = at
    while n - last > _MOST:
        last += _MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


@dataclass(frozen=True, slots=True)
class Summary:
    """What a chunk adds to its document."""

    chars: int
    lines: int
    marked: bool
    head: bytes
    tail: bytes


def summary(chunk: bytes) -> Summary:
    """Code points are the bytes that don't continue one, so a border inside a character does no harm."""
    chars = len(chunk) if chunk.isascii() else int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))
    marked = _OPEN in chunk and any(m in chunk for m in _MARKS)
    return Summary(chars, chunk.count(b"\n"), marked, chunk[:2], chunk[-2:])


class Memory:
    """Summaries of the chunks a task has met, under their content."""

    def __init__(self, most: int = MEMORY) -> None:
        self._known: dict[bytes, Summary] = {}
        self._bytes, self._most = 0, most

    def of(self, chunk: bytes) -> Summary:
        found = self._known.get(chunk)
        if found is None:
            if self._bytes + len(chunk) > self._most:
                for old in list(self._known)[: len(self._known) // 2 + 1]:
                    self._bytes -= len(old)
                    del self._known[old]
            found = self._known[chunk] = summary(chunk)
            self._bytes += len(chunk)
        return found


class Document:
    """A text as chunks with running sums of their summaries."""

    def __init__(self, data: bytes, memory: Memory) -> None:
        self.data, self.ends = data, chunk_ends(data)
        self.starts = [0, *self.ends[:-1]]
        parts = [memory.of(data[a:b]) for a, b in zip(self.starts, self.ends, strict=False)]
        self.chars = list(accumulate((p.chars for p in parts), initial=0))
        self.lines = list(accumulate((p.lines for p in parts), initial=0))
        self.marked = any(p.marked for p in parts) or self._marked_between(parts)

    @staticmethod
    def _marked_between(parts: list[Summary]) -> bool:
        # Only the last chunk can be shorter than two bytes, so a sentinel spans at most two chunks.
        return any(m in a.tail + b.head for a, b in zip(parts, parts[1:], strict=False) for m in _MARKS)

    @property
    def units(self) -> int:
        return self.lines[-1] + (bool(self.data) and not self.data.endswith(b"\n"))

    def after(self, units: int) -> tuple[int, int]:
        """Byte and code point at which the first `units` lines end."""
        if units <= 0:
            return 0, 0
        if units > self.lines[-1]:
            return len(self.data), self.chars[-1]
        k = bisect_left(self.lines, units) - 1
        at = self.starts[k]
        for _ in range(units - self.lines[k]):
            at = self.data.index(b"\n", at) + 1
        return at, self.chars[k] + summary(self.data[self.starts[k] : at]).chars


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers fixed by seed and document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _moved(doc_id: int | None, text: str | None, memory: Memory, seed: int, rate: int, spm_rate: int) -> tuple:
    data = (text or "").encode()
    document = Document(data, memory)
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = document.units
    if not data or document.marked or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, data
    (a, a_chars), (b, b_chars) = (document.after(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = _MARKS
    spm = h4 % 100 < spm_rate
    out = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return doc_id, n, "spm" if spm else "psm", a_chars, b_chars - a_chars, out


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output (the transformed text).

    `rate` percent of the documents are transformed, `spm_rate` percent of those with the suffix first. Other columns are
    ignored. A missing text counts as empty; empty texts and texts that hold a sentinel stay plain. A row without doc_id draws
    from the seed alone; repeated rows give equal rows; an empty table gives none. No shuffle; a task holds one batch of
    rows and its bounded memory of chunks.
    """
    names = SCHEMA.replace(" long", "").replace(" string", "").split(", ")

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = [_moved(d, t, memory, seed, rate, spm_rate) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
        columns = dict(zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True))
        columns["output"] = pa.array(columns["output"], pa.binary()).cast(pa.string())
        yield columns

    memory = Memory()
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), per_batch, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The original text, from the transformed one and its form alone."""
    def between(left: str, right: str | None = None) -> Column:
        start = F.locate(SENTINELS[left], output) + 3
        stop = F.length(output) + 1 if right is None else F.locate(SENTINELS[right], output)
        return F.substring(output, start, stop - start)

    psm = F.concat(between("prefix", "suffix"), between("middle"), between("suffix", "middle"))
    spm = F.concat(between("prefix", "middle"), between("middle"), between("suffix", "prefix"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
