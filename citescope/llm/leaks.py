"""Benchmark decontamination: pieces of test items found exactly, then verified with bit-parallel edit distance."""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Characters of test items that one automaton may hold; larger sets are searched block by block.
BLOCK_CHARS = 4_000_000
_GRAM = 4


def normal(text: str | None) -> str:
    """Lower case, white space as one blank."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float) -> int:
    """Edits allowed for an item of that many characters."""
    return int(length * rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces of nearly equal length; any text within `edits` holds one unchanged."""
    n, k = len(item), edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def best_match(item: str, text: str, start: int, end: int, edits: int) -> tuple[int, int] | None:
    """(distance, end): the best end of `item` inside text[start:end] within `edits`, by Myers' bit-parallel columns.

    The item may begin anywhere. Of equally good ends the first counts.
    """
    m = len(item)
    if not m:
        return None
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, None
    for j in range(start, end):
        eq = peq.get(text[j], 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp)
        hn = vp & xh
        score += bool(hp & top) - bool(hn & top)
        hp <<= 1
        hn <<= 1
        vp = (hn | ~(xv | hp)) & full
        vn = hp & xv & full
        if score <= edits and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def gram_counts_allow(grams: list[str], window: str, edits: int) -> bool:
    """Could a window hold the item? An edit spoils at most `_GRAM` of the item's grams; the others are in the window."""
    least = len(grams) - _GRAM * edits
    if least <= 0:
        return True
    there = {window[i : i + _GRAM] for i in range(len(window) - _GRAM + 1)}
    return sum(map(there.__contains__, grams)) >= least


class _Block:
    """Automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = {i: (text, budget(len(text), rate)) for i, text in items if text}
        self.grams = {i: [text[k : k + _GRAM] for k in range(len(text) - _GRAM + 1)] for i, (text, _) in self.items.items()}
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (text, edits) in self.items.items():
            for offset, piece in pieces(text, edits):
                where[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def hits(self, text: str) -> dict[int, tuple[int, int]]:
        """item -> (distance, end) of its best occurrence in a normalized text."""
        if self.empty:
            return {}
        spans: dict[int, list[list[int]]] = defaultdict(list)
        for last, (size, at) in self.automaton.iter(text):
            begin = last - size + 1
            for i, offset in at:
                item, edits = self.items[i]
                a = max(0, begin - offset - edits)
                b = min(len(text), begin - offset + len(item) + edits)
                own = spans[i]
                if own and a <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
                else:
                    own.append([a, b])
        found = {}
        for i, own in spans.items():
            item, edits = self.items[i]
            matches = [
                m for a, b in own
                if gram_counts_allow(self.grams[i], text[a:b], edits) and (m := best_match(item, text, a, b, edits))
            ]
            if matches:
                found[i] = min(matches)
        return found


def _blocks(benchmark: DataFrame, block_chars: int) -> list[list[tuple[int, str]]]:
    """Items in blocks of bounded size, read one after the other. Items without text can't leak and are left out."""
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text")
    blocks, size = [[]], 0
    for item_id, text in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if size and size + len(text) > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((item_id, text))
        size += len(text)
    return blocks


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, item_chars): test items contained in whole document texts, up to edits.

    An item of n characters (lower case, white space as one blank) may differ in int(n * rate) inserted, deleted or
    changed characters. It is split into one piece more than that, so one piece must be unchanged; exact piece hits
    name the windows, which are verified whole. Pairs are distinct, each with the smallest distance. Test items are
    the query side and split into blocks of `block_chars` characters, each searched in a scan of its own; documents
    are never shuffled. Missing and empty texts or items, items without item_id and empty tables give no rows; a
    document without doc_id is reported with a missing doc_id. Other columns are ignored.
    """
    found = None
    for block in _blocks(benchmark, block_chars):
        made: dict[str, _Block] = {}

        def per_batch(batch, block=block, made=made):
            if "it" not in made:
                made["it"] = _Block([(k, text) for k, (_, text) in enumerate(block)], rate)
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (distance, _) in sorted(made["it"].hits(normal(text)).items()):
                    rows.append((doc, block[k][0], distance, len(block[k][1])))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield dict(zip(("doc_id", "item_id", "distance", "item_chars"), columns, strict=True))

        part = map_rows(
            docs.select(F.col("doc_id").cast("long"), "text"), per_batch,
            "doc_id long, item_id long, distance int, item_chars int",
        )
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("item_chars").alias("item_chars"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1) -> DataFrame:
    """Documents that contain no test item. Documents without doc_id can't be named by a hit and stay."""
    return docs.join(leaks(docs, benchmark, rate).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
