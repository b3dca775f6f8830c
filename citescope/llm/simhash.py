"""SimHash near-duplicates: multi-index hashing over fingerprint segments, then connected components."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, map_rows, stored, words

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = 64
#: Shingles whose hashes are held at once.
_CHUNK = 1 << 16
#: Odd factor that joins word hashes to the hash of a run.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Documents sampled for the order of shingles, and usual shingles known by name. Neither changes a result.
_SAMPLE, _USUAL = 1 << 13, 1 << 17
#: 64-bit words of parities per set, and of its long fingerprint: _PRINT_WORDS * 2 segments of up to 32 bits.
_PARITY_WORDS = _PRINT_WORDS = 16
#: Bits of the first word by which similar sets may differ. At the similarity of 0.8 about 10 +- 3 do, of unlike sets 32 +- 4.
_WORD_BITS = 24
#: Keys of up to so many sets, and so many outside their largest group, are compared by a join. Others are crowded.
_LISTED, _PAIRED = 256, 16
#: Sets of a block of a crowd, cells of an array while two blocks are compared, most words of parities per set.
_BLOCK, _CELLS, _ODD_WORDS = 1 << 9, 1 << 16, 1 << 10
#: Leaders that a set meets under each segment, round by round. Later rounds are for sets outside a key's largest group.
_LEADERS = (2, 16)
_STREAMS = np.array([xxhash.xxh64_intdigest(b"stream", i) for i in range(_PRINT_WORDS)], np.uint64)
#: Shingles whose bits are summed in a byte, and texts whose sets are held at once.
_BYTE, _HELD = 240, 256


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half the shingle hashes. 0 without words."""
    tokens = [w.translate(_LOWER) for w in words(text)]
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(shingle, len(tokens))
    n = len(tokens) - size + 1
    first, last = starts[:n].tolist(), ends[size - 1 :].tolist()
    ones = np.zeros(_BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        part = zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed 64-bit number."""

    def per_batch(batch):
        prints = np.array([simhash(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
        yield {"doc_id": batch.column(0), "fp": prints.view(np.int64)}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), per_batch, "doc_id long, fp long")


def _segments(distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius): two halves whose radii r, s have (r + 1) + (s + 1) = distance + 1.

    If both halves differed by more than their radius, the whole would differ by over `distance` bits.
    """
    if distance < 1:
        return [(0, _BITS, 0)]
    low = (distance - 1) // 2
    return [(32, 32, distance - 1 - low), (0, 32, low)]


def _ball(width: int, radius: int, shift: int) -> list[int]:
    """All masks of at most `radius` bits within a segment, as signed 64-bit numbers."""
    masks = [sum(1 << (b + shift) for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << _BITS) if m >> 63 else m for m in masks]


def _mask(width: int, shift: int) -> Column:
    mask = ((1 << width) - 1) << shift
    return F.lit(mask - (1 << _BITS) if mask >> 63 else mask).cast("long")


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(u, v): all pairs of different fingerprints that differ in at most `distance` bits, u < v.

    `prints` has one row per distinct `fp`. Every fingerprint is entered into one table per segment under that
    segment's bits; a probe enumerates the small Hamming ball around its own segment, fetches what the table holds
    and verifies the whole distance. A table entry shared by more fingerprints than the other half's ball has members
    is not scanned: the probe enumerates that ball too and looks the complete fingerprints up, so the work per
    fingerprint is bounded and nothing is capped. Such entries are few, at most one for every member of that ball, and
    the only table that is sent to all executors. Spark takes an exploded table for no larger than what it came from and
    would send out the others too.
    """
    found = None
    for shift, width, radius in _segments(distance):
        mask = _mask(width, shift)
        entries = prints.select(F.col("fp").bitwiseAND(mask).alias("key"), F.col("fp").alias("other"))
        other_shift, other_width = (0 if shift else width), _BITS - width
        rest = _ball(other_width, distance, other_shift) if other_width else [0]
        busy = entries.groupBy("key").count().where(F.col("count") > len(rest)).select("key", F.lit(True).alias("busy"))
        probes = prints.select("fp", F.explode(F.lit(_ball(width, radius, shift))).alias("flip")).select(
            "fp", F.bit_count("flip").alias("spent"), F.col("fp").bitwiseAND(mask).bitwiseXOR(F.col("flip")).alias("key")
        )
        routed = probes.join(F.broadcast(busy), "key", "left")
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
        pairs = routed.where("busy is null").join(entries.hint("merge"), "key").where((F.col("fp") < F.col("other")) & near)
        if other_width:
            crowded = (
                routed.where("busy")
                .select("fp", "spent", "key", F.explode(F.lit(rest)).alias("flip"))
                .where(F.col("spent") + F.bit_count("flip") <= distance)
                .select("fp", F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.bitwise_not(mask)).bitwiseXOR(F.col("flip"))).alias("other"))
                .where("fp < other")
                .join(prints.select(F.col("fp").alias("other")).hint("merge"), "other")
            )
            pairs = pairs.select("fp", "other").unionByName(crowded.select("fp", "other"))
        pairs = pairs.select(F.col("fp").alias("u"), F.col("other").alias("v"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Group documents (doc_id, text) whose fingerprints are linked, directly or through others.

    Returns one row per input row: doc_id, fp (signed), component_id, the smallest doc_id of the group. Equal
    fingerprints are one node, so copies are never paired. Texts without a word have fingerprint 0 and are linked like
    any other; a row without doc_id gets the component of its fingerprint (NULL if no row of it has an id). An empty
    table gives an empty result; columns besides doc_id and text are ignored.
    """
    prints = stored(fingerprints(docs, shingle, seed))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    group = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(group.hint("merge"), nodes["fp"] == group["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Hashes of the different runs of `size` words, ASCII case ignored, ascending. A shorter text is one run."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    size = min(size, len(tokens))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    runs = np.zeros(len(tokens) - size + 1, np.uint64)
    for k in range(size):
        runs = runs * _FACTOR + hashes[k : k + len(runs)]
    return np.unique(runs)


def _name(runs: np.ndarray) -> int:
    value = xxhash.xxh64_intdigest(runs.tobytes(), 1)
    return value - (1 << _BITS) if value >> 63 else value


def _usual(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that several documents of a sample have, and in how many. They only order a prefix."""

    def per_batch(batch):
        found = [shingles(t, size) for t in batch.column(0).to_pylist()]
        yield {"key": np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64)}

    every = max(1, docs.count() // _SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counts = map_rows(sample, per_batch, "key long").groupBy("key").count().where("count > 2")
    rows = counts.orderBy(F.desc("count"), "key").limit(_USUAL).collect()
    found = np.array([(r["key"], r["count"]) for r in rows], np.int64).reshape(-1, 2)
    keys = np.ascontiguousarray(found[:, 0]).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found[order, 1]


def _print(runs: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles, _PRINT_WORDS words: a bit is 1 if it is set in over half the shingles' hashes. 0 without shingles."""
    ones = np.zeros(_BITS * _PRINT_WORDS, np.int64)
    for at in range(0, len(runs), _BYTE):
        mixed = runs[at : at + _BYTE, None] + _STREAMS
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(runs), bitorder="little").view("<i8")


def _sets(docs: DataFrame, size: int, share: Fraction) -> DataFrame:
    """(row, doc_id, node, n, print, parities, odd, keys) of every row. Stored.

    `node` names the set of the text's n shingles, `print` is its fingerprint, `keys` are the shingles, from the rarest, of
    which two similar sets must share one. A text without a word has no keys. `odd` are more parities of a larger set.
    """
    usual, counts = _usual(docs, size)

    def per_part(batch):
        found = [shingles(t, size) for t in batch.column(2).to_pylist()]
        keys = []
        for runs in found:
            n = len(runs)
            frequency = np.zeros(n, np.int64)
            if n and len(usual):
                at = np.minimum(np.searchsorted(usual, runs), len(usual) - 1)
                frequency = np.where(usual[at] == runs, counts[at], 0)
            keys.append(runs[np.argsort(frequency, kind="stable")[: n - math.ceil(share * n) + 1]].view(np.int64))
        return {
            "row": batch.column(0), "doc_id": batch.column(1), "node": [_name(x) for x in found], "n": [len(x) for x in found],
            "print": [_print(x) for x in found], "parities": [_parities(x) for x in found],
            "odd": [_parities(x, w) if (w := _odd_words(len(x))) > _PARITY_WORDS else None for x in found], "keys": keys,
        }

    def per_batch(batch):
        for at in range(0, batch.num_rows, _HELD):
            yield per_part(batch.slice(at, _HELD))

    schema = "row long, doc_id long, node long, n int, print array<long>, parities array<long>, odd array<long>, keys array<long>"
    return stored(map_rows(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), per_batch, schema))


def _fits(n: Column, at: Column, other_n: Column, other_at: Column, share: Fraction) -> Column:
    """Sets whose first common shingle is at these places can still share enough."""
    p, q = share.numerator, share.denominator
    return (p + q) * F.least(n - at, other_n - other_at) >= p * (n + other_n)


def _parities(runs: np.ndarray, words_: int = _PARITY_WORDS) -> np.ndarray:
    """64 bits a word: is the number of shingles odd that have this bit's number? Two sets differ in at least as many shingles as bits."""
    odd = np.bincount((runs & np.uint64(64 * words_ - 1)).astype(np.int64), minlength=64 * words_) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _odd_words(n: int) -> int:
    """Words of parities that tell unlike sets of n shingles apart: two bits a shingle, a power of two."""
    return min(_ODD_WORDS, max(_PARITY_WORDS, 1 << max(0, (2 * n - 1) // 64).bit_length()))


def _folded(parities: np.ndarray, words_: int) -> np.ndarray:
    """What `_parities` with fewer words gives for the same sets, one per row."""
    while parities.shape[1] > words_:
        half = parities.shape[1] // 2
        parities = parities[:, :half] ^ parities[:, half:]
    return parities


def _likely(crowd: pa.Table, share: Fraction) -> pa.Table:
    """(u, v): the pairs of a crowd's blocks `lo` and `hi` that are of different groups and can be that similar by size and parities.

    Every pair is looked at but those within the blocks' largest group. What is held at once doesn't grow with their number.
    """
    p, q = share.numerator, share.denominator
    node, n, root, block = (crowd[c].to_numpy() for c in ("node", "n", "root", "block"))
    n = n.astype(np.int64)
    lists = crowd["odd"].combine_chunks()
    widths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(widths)
    place, parities = np.zeros(len(node), np.int64), {}
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        place[rows] = np.arange(len(rows))
        parities[w] = values[(ends[rows] - w)[:, None] + np.arange(w)]
    groups, counts = np.unique(root, return_counts=True)
    others = np.flatnonzero(root != groups[counts.argmax()])
    rank = np.full(len(node), len(node))
    rank[others] = np.arange(len(others))
    within = crowd["lo"][0].as_py() == crowd["hi"][0].as_py()
    u, v = [], []
    step = max(1, _CELLS // len(node))
    for at in range(0, len(others), step):
        a = others[at : at + step]
        met = (root[a][:, None] != root) & (rank[a][:, None] < rank)
        met &= q * np.minimum(n[a][:, None], n) >= p * np.maximum(n[a][:, None], n)
        if not within:
            met &= block[a][:, None] != block
        i, j = np.nonzero(met)
        i = a[i]
        kinds = widths[i].astype(np.int64) << 32 | widths[j]
        for kind in np.unique(kinds).tolist():
            x, y = kind >> 32, kind & 0xFFFFFFFF
            of_kind = np.flatnonzero(kinds == kind)
            part = max(1, _CELLS // max(x, y))
            for k in range(0, len(of_kind), part):
                c, d = i[of_kind[k : k + part]], j[of_kind[k : k + part]]
                differ = _folded(parities[x][place[c]], min(x, y)) ^ _folded(parities[y][place[d]], min(x, y))
                near = (p + q) * np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= (q - p) * (n[c] + n[d])
                u.append(np.minimum(node[c[near]], node[d[near]]))
                v.append(np.maximum(node[c[near]], node[d[near]]))
    none = np.empty(0, np.int64)
    return pa.table({"u": np.concatenate([none, *u]), "v": np.concatenate([none, *v])})


def _texts_sets(docs: DataFrame, sets: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, n, shingles) of the wanted `nodes`. Only their texts are read again. Stored."""

    def per_part(batch):
        found = [shingles(t, size) for t in batch.column(1).to_pylist()]
        return {"wanted": batch.column(0), "node": [_name(x) for x in found], "n": [len(x) for x in found], "shingles": [x.view(np.int64) for x in found]}

    def per_batch(batch):
        for at in range(0, batch.num_rows, _HELD):
            yield per_part(batch.slice(at, _HELD))

    wanted = nodes.select("node").distinct().join(sets.select("node", "doc_id"), "node")
    texts = docs.join(stored(wanted), "doc_id").select("node", "text")
    found = map_rows(texts, per_batch, "wanted long, node long, n int, shingles array<long>").where("wanted = node")
    return stored(found.drop("wanted").dropDuplicates(["node"]))


def _sides(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """`pairs` (u, v) with n and `column` of either set."""
    u, v = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"of_{x}")) for x in "uv")
    return pairs.join(u, "u").join(v, "v")


def _similar(docs: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, share: Fraction) -> DataFrame:
    """The `pairs` (u, v) of sets with at least that Jaccard similarity. Stored.

    Parities leave out pairs that differ in too many shingles; the others are compared on all shingles.
    """
    p, q = share.numerator, share.denominator
    total = F.col("n_u") + F.col("n_v")
    bits = [F.bit_count(F.get("of_u", F.lit(k)).bitwiseXOR(F.get("of_v", F.lit(k)))) for k in range(_PARITY_WORDS)]
    apart = reduce(lambda x, y: x + y, bits)
    likely = stored(_sides(pairs, sets, "parities").where((p + q) * apart <= (q - p) * total).select("u", "v"))
    whole = _texts_sets(docs, sets, likely.select(F.explode(F.array("u", "v")).alias("node")), size)
    common = F.size(F.array_intersect("of_u", "of_v"))
    return stored(_sides(likely, whole, "shingles").where((p + q) * common >= p * total).select("u", "v"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` (node, root) after further `links` (u, v) of nodes. Only links between the groups so far are followed. Stored."""
    of_u, of_v = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv")
    between = links.join(of_u, "u").join(of_v, "v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    merged = stored(components(between).select(F.col("node").alias("root"), F.col("root").alias("least")))
    return stored(roots.join(merged, "root", "left").select("node", F.coalesce("least", "root").alias("root")))


def _segment_keys(width: int) -> Column:
    """One number per segment of `print`: the segment's place and its lowest `width` bits."""
    halves = [F.shiftrightunsigned(F.get("print", F.lit(s // 2)), 32 * (s % 2)) for s in range(2 * _PRINT_WORDS)]
    return F.array(*[h.bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(s << 32)).cast("long") for s, h in enumerate(halves)])


def _main(rows: DataFrame) -> DataFrame:
    """(key, main, size, sets): the largest group of every key of `rows` (key, root), its number of sets and that of all groups."""
    sizes = rows.groupBy("key", "root").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "root")).alias("main"), F.sum("count").alias("sets"))
    return main.select("key", F.col("main.root").alias("main"), F.col("main.count").alias("size"), "sets")


def _shared(rows: DataFrame) -> DataFrame:
    """The `rows` (node, key, ...) whose key several sets have. Stored. Most keys have one set."""
    sizes = rows.groupBy("key").count().where("count > 1")
    return stored(rows.join(sizes.select("key"), "key", "left_semi"))


def _segment_rows(sets: DataFrame) -> DataFrame:
    """(node, key): the segments of fingerprints in which several sets agree. Stored."""
    # Keys have a few bits more than it takes to number the sets, so unlike sets rarely meet.
    width = min(32, max(8, math.ceil(math.log2(max(1, sets.count()))) + 2))
    return _shared(sets.select("node", F.explode(_segment_keys(width)).alias("key")))


def _print_pairs(sets: DataFrame, roots: DataFrame, leaders: int, outside: bool, agreeing: DataFrame | None = None, tested: DataFrame | None = None) -> DataFrame:
    """Candidates (u, v) by multi-index hashing: sets of different groups that agree in a segment of the fingerprint, near in its first word.

    Every set, or with `outside` every one that is not in its key's largest group, meets `leaders` of each of its keys, drawn
    anew for each key, so the work is linear in the sets however many agree. `roots` (node, root) has all sets; `agreeing`
    are the `_segment_rows`, if they are known. Pairs that were `tested` (u, v) don't come up again.
    """
    rows = (_segment_rows(sets) if agreeing is None else agreeing).join(roots, "node")
    mixed = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    searching = stored(rows.join(mixed.select("key"), "key", "left_semi"))
    salts = [F.xxhash64("key", F.lit(leaders), F.lit(i)) for i in range(leaders)]
    drawn = F.array(*[F.min(F.col("node").bitwiseXOR(salt)).bitwiseXOR(salt) for salt in salts])
    tops = searching.groupBy("key").agg(F.array_distinct(drawn).alias("tops"))
    if outside:
        searching = searching.join(_main(searching), "key").where("root <> main")
    met = searching.join(tops, "key").select("node", F.explode("tops").alias("top")).where("node <> top")
    pairs = met.select(F.least("node", "top").alias("u"), F.greatest("node", "top").alias("v")).distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["u", "v"], "left_anti")
    words_ = sets.select("node", F.get("print", F.lit(0)).alias("word")).join(roots, "node")
    u, v = (words_.select(F.col("node").alias(x), F.col("word").alias(f"of_{x}"), F.col("root").alias(f"root_{x}")) for x in "uv")
    near = F.bit_count(F.col("of_u").bitwiseXOR(F.col("of_v"))) <= _WORD_BITS
    return stored(pairs.join(u, "u").join(v, "v").where((F.col("root_u") != F.col("root_v")) & near).select("u", "v"))


def _crowds(rows: DataFrame) -> DataFrame:
    """(crowd, node): sets that share a key of `rows` (key, node) are together in a crowd. Stored.

    A passage in many texts gives many keys to nearly the same sets. A key is put with the largest key that most of its sets
    have, where all sets of such keys make no more pairs than the keys one by one.
    """
    sized = stored(rows.join(rows.groupBy("key").agg(F.count("*").alias("size")), "key"))
    tops = sized.groupBy("node").agg(F.max(F.struct("size", "key")).alias("top")).select("node", F.col("top.key").alias("top"))
    votes = sized.join(tops, "node").groupBy("key", "size", "top").count()
    leads = votes.groupBy("key", "size").agg(F.max(F.struct("count", "top")).alias("most"))
    leads = stored(leads.select("key", "size", F.col("most.top").alias("lead")))
    named = sized.select("key", "node").join(leads.select("key", "lead"), "key")
    together = named.groupBy("lead").agg(F.count_distinct("node").cast("double").alias("together"))
    alone = leads.groupBy("lead").agg(F.sum(F.col("size").cast("double") ** 2).alias("alone"))
    joined = together.join(alone, "lead").select("lead", (F.col("together") ** 2 <= F.col("alone")).alias("joined"))
    crowd = F.struct("joined", F.when(F.col("joined"), F.col("lead")).otherwise(F.col("key")).alias("id")).alias("crowd")
    return stored(named.join(joined, "lead").select(crowd, "node").distinct())


def _crowd_pairs(sets: DataFrame, rows: DataFrame, share: Fraction) -> DataFrame:
    """Candidates (u, v): sets of different groups that share a key of `rows` (key, node, n, root).

    A crowd is dealt into blocks, and every two blocks of it, or one with itself, meet in one call of `_likely`: the sets
    that Spark moves grow with the blocks of a crowd, not with its pairs, and a large crowd is spread over all tasks.
    """
    members = _crowds(rows.select("key", "node"))
    sizes = members.groupBy("crowd").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    known = rows.select("node", "n", "root").dropDuplicates(["node"])
    known = known.join(sets.select("node", F.coalesce("odd", "parities").alias("odd")), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "crowd").withColumn("block", block)
    dealt = dealt.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("crowd", "node", "block", F.least("block", "meets").alias("lo"), F.greatest("block", "meets").alias("hi"))

    def per_pair(crowd: pa.Table) -> pa.Table:
        return _likely(crowd, share)

    return dealt.join(known, "node").groupBy("crowd", "lo", "hi").applyInArrow(per_pair, "u long, v long").distinct()


def _key_pairs(sets: DataFrame, roots: DataFrame, share: Fraction) -> DataFrame:
    """Candidates (u, v): all sets of different groups that share one of their `keys` and can be that similar. Stored.

    In keys of up to _LISTED sets with up to _PAIRED outside the key's largest group these are pairs by a join, at most
    _PAIRED per set; the other keys are crowded (see `_crowd_pairs`). A pair can be ruled out by the places of its first
    common key only, so crowds, which may not show it, don't use them.
    """
    shared = _shared(sets.select("node", F.posexplode("keys").alias("at", "key")))
    rows = stored(shared.join(sets.select("node", "n").join(roots, "node"), "node"))
    mixed = stored(_main(rows).where(F.col("size") < F.col("sets")))
    few = (F.col("sets") <= _LISTED) & (F.col("sets") - F.col("size") <= _PAIRED)
    open_ = stored(rows.join(mixed.where(few), "key"))
    a, b = open_.where("root <> main").alias("a"), open_.alias("b")
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    fits = _fits(F.col("a.n"), F.col("a.at"), F.col("b.n"), F.col("b.at"), share)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & once & fits)
    pairs = met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    crowded = stored(rows.join(mixed.where(~few).select("key"), "key", "left_semi"))
    return stored(pairs.unionByName(_crowd_pairs(sets, crowded, share)).distinct())


def _grouped(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The `_sets` of all rows with a doc_id, and (node, first_id, root) of every distinct set (see `similar_groups`)."""
    share = Fraction(str(similarity))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    rows = _sets(docs, shingle, share)
    first = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    first = rows.select("row", "node", "doc_id").join(first, ["node", "doc_id"]).groupBy("node").agg(F.min("row").alias("row"))
    sets = rows.join(stored(first.select("row")), "row", "left_semi")
    nodes = stored(sets.select("node", F.col("doc_id").alias("first_id")))
    some = sets.where("n > 0")
    tested = None
    roots = nodes.select("node", F.col("node").alias("root"))
    agreeing = _segment_rows(some)
    for leaders in _LEADERS:
        pairs = _print_pairs(some, roots, leaders, tested is not None, agreeing, tested)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = _merged(roots, _similar(docs, some, pairs, shingle, share))
    pairs = stored(_key_pairs(some, roots, share).join(tested, ["u", "v"], "left_anti"))
    roots = _merged(roots, _similar(docs, some, pairs, shingle, share))
    return rows, nodes.join(roots, "node").select("node", "first_id", "root")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, first_id, group_id) of every distinct set of shingles: groups linked by a Jaccard similarity of at least `similarity`.

    `first_id` is the smallest doc_id of the set, `group_id` that of the group. SimHash with multi-index hashing finds the
    first candidates: each of the segments of a set's long fingerprint is entered into a table, sets that agree in one meet
    (see `_print_pairs`; fingerprints that differ in fewer bits than there are segments always agree in one). All pairs of
    sets that are then still in different groups are looked up by their rarest shingles: two sets that are so similar share
    one of their rarest n - ceil(similarity * n) + 1 shingles, whatever the order of shingles (see `_key_pairs`). Candidates
    are verified on all shingles, so the groups are exact.
    """
    rooted = _grouped(docs, shingle, similarity)[1]
    least = rooted.groupBy("root").agg(F.min("first_id").alias("group_id"))
    return rooted.join(least, "root").select("node", "first_id", "group_id")


def _texts_of(docs: DataFrame, stands: DataFrame, size: int) -> DataFrame:
    """(doc_id, text): one text of every set of `stands` (doc_id, node) among the rows of its id, the least."""

    def per_batch(batch):
        yield {"doc_id": batch.column(0), "text": batch.column(1), "node": [_name(shingles(t, size)) for t in batch.column(1).to_pylist()]}

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(stands.select("doc_id"), "doc_id", "left_semi").distinct()
    named = map_rows(texts, per_batch, "doc_id long, text string, node long")
    return stored(named.join(stands, ["doc_id", "node"]).groupBy("doc_id", "node").agg(F.min("text").alias("text")).drop("node"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Documents without near-duplicates: of each group of `similar_groups` the row of the smallest doc_id stays, once.

    Rows without a doc_id can't stand for a group and link none; they stay as they are. Texts without a word are one group.
    An id of several texts stands for every group of which it is the smallest, with a text of that group.
    """
    rows, rooted = _grouped(docs, shingle, similarity)
    stands = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").alias("doc_id"), "node")).alias("first"))
    stands = stored(stands.select("first.*"))
    several = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    several = stored(several.select("doc_id"))
    kept = docs.join(stands.select("doc_id"), "doc_id", "left_semi")
    if several.isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    else:
        texts = _texts_of(docs, stands.join(several, "doc_id", "left_semi"), shingle)
        same = (docs["doc_id"] == texts["doc_id"]) & docs["text"].eqNullSafe(texts["text"])
        chosen = docs.join(texts, same, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(several, "doc_id", "left_anti").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(chosen)
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
