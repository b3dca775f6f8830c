"""Token ids as Re-Pair blocks: frequent id pairs become nonterminals, with rules and expansion lengths kept."""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, stored

END = 2
#: Ids per block at least, unless the shard ends; a block never cuts a document.
BLOCK_IDS = 1 << 20
#: Units whose ids a worker remembers before it forgets all but the latest half, and the longest that the library gets joined.
_REMEMBERED, _LONGEST = 1_000_000, 64
#: Bytes of text cut at once, unless one text is longer, and unknown units that the library gets at once.
_SLICE, _JOINED = 1 << 23, 128
#: A blank before which a pre-token always ends.
_CUT = re.compile(r"(?<=\S) | (?=\S)")


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return "".join(chr(b if b in shown else 256 + others.index(b)) for b in range(256))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `starts` and have `sizes`, one run after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(sizes.sum())


class Encoder:
    """Ids of whole texts by the tokenizers library, which gets each different unit once while it is remembered.

    A byte-level tokenizer's pre-tokens never cross most blanks, so texts are cut there. A mark after a unit's last letter is
    a pre-token of its own. Arrow finds the different units of a slice of texts; unknown ones go to the library in one text,
    whose ids are cut where a blank starts. Texts for tokenizers of any other form go whole through the library.
    """

    def __init__(self, path: str):
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        first, model, added = settings["pre_tokenizer"] or {}, settings["model"], settings["added_tokens"]
        letters, specials = _byte_letters(), "".join(t["content"] for t in added)
        #: May texts be cut at blanks? Pre-tokens are then cut by the fixed pattern and nothing else, and no byte lacks an id.
        self.cuts = (
            first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
            and settings["normalizer"] is None and settings["truncation"] is None and settings["padding"] is None
            and model["type"] == "BPE" and all(x in model["vocab"] for x in letters)
            and not any(t["lstrip"] or t["rstrip"] for t in added) and not any(map(str.isspace, specials))
        )
        if not self.cuts:
            return
        #: Does an id stand for a blank and what follows it?
        self.blank = np.zeros(1 + max([*model["vocab"].values(), *(t["id"] for t in added)]), bool)
        self.blank[[k for token, k in model["vocab"].items() if token[0] == letters[32]]] = True
        self.blank[[t["id"] for t in added]] = False
        marks = sorted(set(string.punctuation) - set(specials))
        self.marks, self.mark_ids = pa.array(marks, pa.string()), np.array([model["vocab"][m] for m in marks], "<u4")
        #: Letters and digits of every Unicode version, each with a mark behind it.
        self.ended = pa.array([chr(c) + m for c in range(0x250) if chr(c).isalnum() for m in marks], pa.string())
        # Places of units, ids of a blank and the unit after it, and the slice that met them last.
        self.known, self.ids, self.sizes = {}, np.empty(0, "<u4"), np.empty(0, np.int64)
        self.met, self.slice = np.empty(0, np.int64), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(" " + " ".join(units))
        sizes = np.diff(np.flatnonzero(self.blank[ids]), append=len(ids))
        if len(sizes) != len(units):
            raise ValueError("the ids of joined units can't be told apart")
        return ids, sizes

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each unit) of a blank and the unit after it, for each unit."""
        self.slice += 1
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            asked = [units[k] for k in unknown.tolist()]
            new = dict.fromkeys(asked)
            short = [x for x in new if 0 < len(x) <= _LONGEST and not x[0].isspace() and " " not in x]
            found = [self._joined(short[a : a + _JOINED]) for a in range(0, len(short), _JOINED)]
            if len(short) < len(new):
                others = list(new.keys() - set(short))
                found += [(ids, np.array([len(ids)])) for ids in (self._ids(" " + x) for x in others)]
                short += others
            self.known.update(zip(short, range(len(self.known), len(self.known) + len(short))))
            at[unknown] = [self.known[x] for x in asked]
            self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
            self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in found)])
            self.met = np.concatenate((self.met, np.zeros(len(short), np.int64)))
        self.met[at] = self.slice
        starts, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes[at]
        ids = self.ids[_ragged(starts[at], sizes)]
        if len(self.known) > _REMEMBERED or len(self.ids) > 8 * _REMEMBERED:
            # The latest half stays, long ones go.
            latest = np.argsort(-self.met, kind="stable")[: _REMEMBERED // 2]
            kept = np.sort(latest[self.sizes[latest] <= _LONGEST // 4])
            names = list(self.known)
            self.known = {names[k]: n for n, k in enumerate(kept.tolist())}
            self.ids = self.ids[_ragged(starts[kept], self.sizes[kept])]
            self.sizes, self.met = self.sizes[kept], self.met[kept]
        return ids, sizes

    def _cut(self, texts) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = split.flatten().dictionary_encode()
        code, units = coded.indices.to_numpy(), coded.dictionary
        first = code[bounds[:-1]]
        heads = units.take(pa.array(first)).to_pylist()
        # A text's first unit has no blank before it, so the library gets it as it is.
        asked = np.flatnonzero(np.bincount(code, minlength=len(units)) > np.bincount(first, minlength=len(units)))
        ended = pc.is_in(pc.utf8_slice_codeunits(units, -2), value_set=self.ended)
        stems = pc.if_else(ended, pc.utf8_slice_codeunits(units, 0, -1), units)
        sizes = np.zeros(len(units), np.int64)
        ids, sizes[asked] = self._units(stems.take(pa.array(asked)).to_numpy(zero_copy_only=False).tolist())
        at = asked[ended.to_numpy(zero_copy_only=False)[asked]]
        mark = pc.index_in(pc.utf8_slice_codeunits(units.take(pa.array(at)), -1), value_set=self.marks).to_numpy()
        ids = np.insert(ids, np.cumsum(sizes)[at], self.mark_ids[mark])
        sizes[at] += 1
        starts, out = np.cumsum(sizes) - sizes, []
        for a in range(0, len(texts), 256):
            near = bounds[a : a + 257]
            own = code[near[0] : near[-1]]
            times = sizes[own]
            times[near[:-1] - near[0]] = 0
            found, ends = ids[_ragged(starts[own], times)], np.cumsum(times)[near[1:] - near[0] - 1].tolist()
            out += [np.concatenate((self._ids(head), found[b:c])) for head, b, c in zip(heads[a : a + 256], [0, *ends], ends)]
        kinds = pc.utf8_slice_codeunits(units, 0, 1).dictionary_encode()
        crossed = np.array([not x or x.isspace() for x in kinds.dictionary.to_pylist()])[kinds.indices.to_numpy()][code]
        crossed[bounds[:-1]] = False
        # A pre-token may go on over a blank of these texts.
        crossed = np.unique(np.searchsorted(bounds, np.flatnonzero(crossed), "right") - 1).tolist()
        pieces = [_CUT.split(texts[k].as_py()) for k in crossed]
        if pieces:
            ids, sizes = self._units([unit for _, *rest in pieces for unit in rest])
            upto = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0] + [len(x) - 1 for x in pieces])].tolist()
            for k, (first, *_), b, c in zip(crossed, pieces, upto, upto[1:]):
                out[k] = np.concatenate((self._ids(first), ids[b:c]))
        return out

    def slices(self, texts) -> Iterator[list[np.ndarray]]:
        """Ids of some texts after the other, as lists of arrays. texts: an Arrow array of strings."""
        import pyarrow.compute as pc

        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _SLICE, "right")))
            part = texts.slice(start, stop - start)
            yield self._cut(part) if self.cuts else [self._ids(t or "") for t in part.to_pylist()]
            start = stop

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        import pyarrow as pa

        return [ids for found in self.slices(pa.array(texts, pa.string())) for ids in found]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def _by_pair(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts, places): the different pairs that start at `at`, and their places, pair by pair."""
    bits, place_bits = int(symbols.max()).bit_length(), len(symbols).bit_length()
    pair = (symbols[at].astype(np.uint64) << np.uint64(bits)) | symbols[at + 1]
    if 2 * bits + place_bits <= 64:
        # A pair and its place fit one number: sorting those numbers groups the places.
        pair <<= np.uint64(place_bits)
        pair |= at.astype(np.uint64)
        pair.sort()
        places = (pair & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        pair >>= np.uint64(place_bits)
    else:
        order = np.argsort(pair, kind="stable")
        pair, places = pair[order], at[order]
    starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    pairs = pair[starts]
    left, right = (pairs >> np.uint64(bits)).astype(np.uint32), (pairs & np.uint64((1 << bits) - 1)).astype(np.uint32)
    return left, right, np.diff(starts, append=len(pair)), places


def repair(ids: np.ndarray, doc_ends: np.ndarray, first_rule: int, least: int = 32, share: int = 32):
    """(symbols, rules, ends): Re-Pair of one block.

    Each round counts neighbouring pairs and replaces the most frequent ones (those with at least 1/`share` of the top
    count), left to right, by new nonterminals; rules[k] is the pair of nonterminal first_rule + k. Pairs never cross the
    end of a document, so `ends` (where documents end among the symbols) allows decoding one alone. Ends when no pair
    occurs `least` times.
    """
    symbols = ids.astype(np.uint32)
    ends = doc_ends
    rules: list[np.ndarray] = []
    base = first_rule
    live = np.ones(len(symbols), bool)  # may the pair that starts here occur `least` times?
    live[ends - 1] = False
    while len(at := np.flatnonzero(live[:-1])):
        left, right, counts, places = _by_pair(symbols, at)
        if counts.max() < least:
            break
        cut = max(least, counts.max() // share)
        starts = np.cumsum(counts) - counts
        # Pairs of old symbols that don't occur often enough now never will: the next round looks at those left and at new ones.
        later = np.flatnonzero((counts >= least) & (counts < cut))
        live[:] = False
        live[places[_ragged(starts[later], counts[later])]] = True
        chosen = np.flatnonzero(counts >= cut)
        named = np.sort((places[_ragged(starts[chosen], counts[chosen])] << 32) | np.repeat(np.arange(len(chosen)), counts[chosen]))
        places, named = named >> 32, named & 0xFFFFFFFF
        # Of overlapping occurrences every second one counts, from the left.
        order = np.arange(len(places))
        run_start = np.maximum.accumulate(np.where(np.diff(places, prepend=-2) > 1, order, 0))
        take = np.flatnonzero(((order - run_start) & 1) == 0)
        places, named = places[take], named[take]
        symbols[places] = (base + named).astype(np.uint32)
        live[places] = True
        live[np.maximum(places, 1) - 1] = True
        stay = np.ones(len(symbols), bool)
        stay[places + 1] = False
        stay = np.flatnonzero(stay)
        symbols, live, ends = symbols[stay], live[stay], np.searchsorted(stay, ends)
        live[ends - 1] = False
        rules.append(np.stack([left[chosen], right[chosen]], axis=1))
        base += len(chosen)
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return symbols, table, ends


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each nonterminal stands for. Rules only use symbols before them."""
    lengths = np.ones(len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[k] = (lengths[a - first_rule] if a >= first_rule else 1) + (lengths[b - first_rule] if b >= first_rule else 1)
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids of some symbols: all rules are written out, one level a step, then each nonterminal gives way to its own ids."""
    rules = rules.astype(np.uint32)
    ids, sizes = rules.ravel(), np.full(len(rules), 2)
    while len(inner := np.flatnonzero(ids >= first_rule)):
        pairs = rules[ids[inner] - np.uint32(first_rule)]
        sizes += np.bincount(np.searchsorted(np.cumsum(sizes), inner, "right"), minlength=len(rules))
        ids = ids.copy()
        ids[inner] = pairs[:, 0]
        ids = np.insert(ids, inner + 1, pairs[:, 1])
    source = np.concatenate((np.arange(first_rule, dtype=np.uint32), ids))
    begin = np.concatenate((np.arange(first_rule), first_rule + np.cumsum(sizes) - sizes))
    times = _symbol_sizes(symbols, sizes, first_rule)
    upto = np.cumsum(times)
    return source[np.repeat(begin[symbols] - upto + times, times) + np.arange(times.sum())]


def _symbol_sizes(symbols: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each symbol stands for; lengths: those of the nonterminals."""
    return np.concatenate((np.ones(first_rule, np.int64), lengths))[symbols]


def decode_slice(symbols, rules, lengths, first_rule: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of some symbols; the expansion lengths tell which symbols to expand."""
    upto = np.cumsum(_symbol_sizes(symbols, lengths, first_rule))
    a, b = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop, "left") + 1
    offset = start - (upto[a - 1] if a else 0)
    return expand(symbols[a:b], rules, first_rule)[offset : offset + stop - start]


def _narrow(values: np.ndarray, limit: int) -> np.ndarray:
    return values.astype("<u2" if limit <= 0xFFFF else "<u4")


BLOCK_SCHEMA = (
    "first_doc long, block int, doc_ids binary, doc_missing binary, symbol_ends binary, symbols binary, wide boolean, "
    "rules binary, rule_lengths binary, n_ids long"
)


def write_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = END, first_rule: int = 50_257, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode (doc_id, text) in ascending doc_id order into Re-Pair blocks, written to a table and read back.

    The table is the file format: a row is a block of whole documents with ids, document ends, symbols (16 bits if
    they fit, else 32), rules and expansion lengths. Shards are ranges of doc_id; a shard's blocks are numbered.
    """
    ordered = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "text")

    def blocks(batches) -> Iterator[dict]:
        held: list[tuple[int | None, np.ndarray]] = []
        size = number = 0
        end = np.array([end_id], "<u4")
        for ids, texts in _gathered(batches):
            docs = iter(ids.to_pylist())
            for part in encoder(tokenizer_path).slices(texts):
                for found in part:
                    held.append((next(docs), np.concatenate((found, end))))
                    size += len(found) + 1
                    if size >= block_ids:
                        yield _block(held, number, first_rule)
                        held, size, number = [], 0, number + 1
        if held:
            yield _block(held, number, first_rule)

    return stored(_whole_partitions(ordered, blocks, BLOCK_SCHEMA))


def _gathered(batches) -> Iterator[list]:
    """The columns of some batches together, as soon as they fill a slice."""
    import pyarrow as pa

    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= _SLICE:
            yield [pa.concat_arrays(columns) for columns in zip(*(b.columns for b in group))]
            group, size = [], 0
    if group:
        yield [pa.concat_arrays(columns) for columns in zip(*(b.columns for b in group))]


def _block(held: list[tuple[int | None, np.ndarray]], number: int, first_rule: int) -> dict:
    ends = np.cumsum([len(x) for _, x in held])
    symbols, rules, symbol_ends = repair(np.concatenate([x for _, x in held]), ends, first_rule)
    limit = int(symbols.max())
    docs = np.array([0 if d is None else d for d, _ in held], "<i8")
    return {
        "first_doc": [held[0][0]], "block": [number], "doc_ids": [docs.tobytes()],
        "doc_missing": [np.packbits([d is None for d, _ in held]).tobytes()], "symbol_ends": [symbol_ends.astype("<u4").tobytes()],
        "symbols": [_narrow(symbols, limit).tobytes()], "wide": [limit > 0xFFFF], "rules": [rules.astype("<u4").tobytes()],
        "rule_lengths": [expansion_lengths(rules, first_rule).astype("<u4").tobytes()], "n_ids": [int(ends[-1])],
    }


def _whole_partitions(df: DataFrame, make, schema: str) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema + ", shard int"))

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for out in make(batches):
            out["shard"] = [shard]
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema + ", shard int")


def read_documents(blocks: DataFrame, first_rule: int = 50_257) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the blocks.

    `start` counts the ids of all documents before it: sums of whole blocks inside a shard, and of whole shards.
    """
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = F.sum("shard_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    starts = (
        blocks.select("shard", "block", "n_ids")
        .withColumn("block_start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(offsets, "shard")
        .select("shard", "block", (F.col("block_start") + F.col("shard_start")).alias("at"))
    )

    def decode(batch) -> Iterator[dict]:
        for row in batch.to_pylist():
            symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2")
            rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
            ends = np.frombuffer(row["symbol_ends"], "<u4").astype(np.int64)
            lengths = np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64)
            tokens = np.concatenate(([0], np.cumsum(_symbol_sizes(symbols, lengths, first_rule))[ends - 1]))
            ids = expand(symbols, rules, first_rule).astype("<u4")
            missing = np.unpackbits(np.frombuffer(row["doc_missing"], np.uint8))[: len(ends)].astype(bool)
            docs = np.frombuffer(row["doc_ids"], "<i8").tolist()
            yield {
                "doc_id": [None if m else d for d, m in zip(docs, missing.tolist(), strict=True)],
                "shard": np.full(len(ends), row["shard"], np.int32), "block": np.full(len(ends), row["block"], np.int32),
                "inner": tokens[:-1], "n_tokens": np.diff(tokens),
                "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(tokens[:-1], tokens[1:], strict=True)],
            }

    decoded = map_rows(
        blocks.select("shard", "block", "doc_ids", "doc_missing", "symbol_ends", "symbols", "wide", "rules", "rule_lengths"),
        decode, "doc_id long, shard int, block int, inner long, n_tokens long, ids_crc32 long",
    )
    return decoded.join(starts, ["shard", "block"]).select("doc_id", (F.col("at") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = END, first_rule: int = 50_257) -> DataFrame:
    """Write all documents as Re-Pair blocks and read every document back from them.

    Returns doc_id, start, n_tokens (with the end id), ids_crc32. Order is ascending doc_id, missing ids first, rows that
    repeat a doc_id by text. Empty and missing texts consist of the end id. `first_rule` is the tokenizer's number of
    ids. An empty table gives an empty result; other columns are ignored.
    """
    return read_documents(write_blocks(docs, tokenizer_path, end_id, first_rule), first_rule)
