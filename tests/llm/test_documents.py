"""Operators on documents against plain versions."""

import random
import time
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citescope.llm import leaks, mixing, queries, repeats, simhash, tokens, toxic
from citescope.llm.common import components, map_rows, stored

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, key string"


def documents(spark, rows):
    """(doc_id, text, source) rows with every other column NULL, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, None, s, None, "x", None, "k") for d, t, s in rows], SCHEMA)


def odd_rows(seed=3, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "naïve", "a b", "日本"]
    rows = [(0, None, "a"), (1, "", "a"), (2, " \t\n", None), (3, "one", "b"), (4, "one two", None)]
    passage = " ".join(rnd.choices(vocabulary, k=70))
    for i in range(5, n):
        text = " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 40, 60, 150, 400])))
        if i % 4 == 0:
            text += "\n" + passage
        if i % 7 == 0:
            text = rows[rnd.randrange(5, max(6, len(rows)))][1] if len(rows) > 6 else text
        rows.append((i, text, rnd.choice(["a", "a", "b", None])))
    rows.append((n, " ".join(rnd.choices(vocabulary, k=30_000)), "a"))
    return rows


def test_repeats(spark):
    rows = odd_rows()
    got = repeats.remove_repeats(documents(spark, rows)).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) h").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute.repeats([(d, t) for d, t, _ in rows])
    again = repeats.remove_repeats(documents(spark, [(None, rows[9][1], None), (7, rows[9][1], None), (7, rows[9][1], None)]))
    assert all(r["n_removed"] == 0 for r in again.collect()) and again.count() == 3
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_repeats_of_the_test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op4_substring_dedup(spark, SMALL).collect()}
    assert got == brute.repeats(rows) and sum(v[1] for v in got.values())


def test_simhash(spark):
    rows = odd_rows(4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    prints = {d: brute.simhash(t) for d, t, _ in rows}
    assert {d: r["fp"] % (1 << 64) for d, r in got.items()} == prints
    assert {d: r["component_id"] for d, r in got.items()} == brute.groups(prints)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_of_the_test_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = {d: brute.simhash(t) for d, t in rows}
    expected = {d: (f"{p:016x}", c) for (d, p), c in zip(prints.items(), brute.groups(prints).values(), strict=True)}
    assert {r[0]: (r[1], r[2]) for r in queries.op6_simhash(spark, SMALL).collect()} == expected


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_in_crowded_entries(spark, distance):
    rnd = random.Random(distance)
    low = rnd.getrandbits(32)
    dense = {(low | rnd.getrandbits(11) << 40) for _ in range(900)} | {low ^ 1 << b for b in range(20)}
    values = sorted(dense | {rnd.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance).collect()}
    signed.sort()
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= distance}
    assert got == expected


def test_simhash_broadcasts_only_busy_entries(spark, monkeypatch):
    """However small Spark takes a table for: exploded ones are larger than their files. Broadcast joins by table written."""
    from citescope.llm import common

    found = []

    def seen(df):
        found.append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin"))
        return stored(df)

    monkeypatch.setattr(common, "stored", seen)
    monkeypatch.setattr(simhash, "stored", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(20)), "a") for i in range(20)]
        got = seen(simhash.near_duplicates(documents(spark, rows)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == [i // 2 * 2 for i in range(20)]
    # Fingerprints, their nodes, the links (entries that are busy or not, in two segments), rounds of components, the result.
    assert len(found) >= 5 and found[:3] == [0, 0, 4] and found[-1] == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}


def test_keep_one(spark):
    rows = [(5, "a b c d", "s"), (3, "a b c d", "s"), (3, "a b c d", "s"), (None, "a b c d", "s"), (9, "x y z", None)]
    kept = simhash.keep_one(documents(spark, rows))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 9] and kept.columns == documents(spark, []).columns


def test_keep_one_of_ids_with_several_texts(spark):
    """An id that is the smallest of several groups stands for each; its text in the group of a smaller id goes."""
    many = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "a b c", "s"), (3, "d e f", "s"), (3, "D e  f", "s"), (3, many, "s"), (3, None, "s"), (3, " ", "s"), (1, many + " x", "s"), (7, "g h", "s")]
    kept = simhash.keep_one(documents(spark, rows * 2)).collect()
    found = sorted((r["doc_id"], " ".join((r["text"] or "").lower().split())) for r in kept)
    assert found == [(1, many + " x"), (3, ""), (3, "a b c"), (3, "d e f"), (7, "g h")]


def similar_texts(seed=8):
    rnd = random.Random(seed)
    rows = [(0, None, "a"), (1, " ", "a"), (2, "one two", "a"), (3, "One TWO", "a"), (4, "one two three", "a")]
    footer = [f"f{i}" for i in range(60)]
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(rnd.choice([6, 12, 44, 104, 204]))] + footer * (group % 3 == 0)
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = f"x{rnd.random()}"
            rows.append((len(rows), " ".join(copy), "a"))
    return rows


def test_keep_one_of_similar_texts(spark):
    for rows in (similar_texts(), [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]):
        expected = brute.similar_groups({d: t for d, t, _ in rows})
        assert len(set(expected.values())) < len(set(brute.groups({d: brute.simhash(t) for d, t, _ in rows}).values()))
        kept = simhash.keep_one(documents(spark, rows))
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))


def test_fingerprints_find_near_copies(spark):
    """SimHash segments give the candidates: as many as the sets allow in a large group, and all that a small one has."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(40)), "a") for i in range(40)]
    for i in range(300):
        copy = list(base)
        copy[rnd.randrange(200)] = f"x{i}"
        rows.append((len(rows), " ".join(copy), "a"))
    docs = documents(spark, rows).select("doc_id", "text")
    sets = simhash._sets(docs, 5, Fraction(4, 5))
    roots = sets.select("node", F.col("node").alias("root"))
    pairs = simhash._print_pairs(sets, roots, 2, False)
    assert pairs.count() <= 2 * 32 * 300
    found = simhash._similar(docs, sets, pairs, 5, Fraction(4, 5))
    named = {r["node"]: r["doc_id"] for r in sets.collect()}
    groups = components(found).groupBy("root").agg(F.collect_set("node").alias("nodes")).collect()
    assert [sorted(named[n] for n in r["nodes"]) for r in groups] == [list(range(40, 340))]


def test_fingerprints_match_a_plain_version():
    runs = simhash.shingles(" ".join(f"w{i}" for i in range(700)))
    mask = (1 << 64) - 1
    for word in (0, 15):
        ones = [0] * 64
        for x in runs.tolist():
            h = x + int(simhash._STREAMS[word]) & mask
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
            h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
            h ^= h >> 31
            ones = [n + (h >> b & 1) for b, n in enumerate(ones)]
        assert int(simhash._print(runs)[word]) % (1 << 64) == sum(1 << b for b, n in enumerate(ones) if 2 * n > len(runs))
    assert not simhash._print(runs[:0]).any() and len(simhash._print(runs)) == 16


def test_keep_one_in_crowded_keys(spark):
    """A passage in most texts, a large group of near copies, and pairs hidden among them: keys too large to be paired."""
    rnd = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(160):
        body = [f"u{i}x{j}" for j in range(rnd.choice([10, 14, 18]))]
        rows.append((len(rows), " ".join(body + passage), "a"))
        if i % 8 == 0:
            rows.append((len(rows), " ".join([*body[:-1], f"y{i}", *passage]), "a"))
    for _ in range(140):
        copy = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            copy[rnd.randrange(200)] = f"x{rnd.random()}"
        rows.append((len(rows), " ".join(copy), "a"))
    expected = brute.similar_groups({d: t for d, t, _ in rows})
    groups = simhash.similar_groups(documents(spark, rows)).collect()
    assert len(set(expected.values())) < 200
    # No wrong link, and nearly none lost.
    assert all(expected[r["first_id"]] == expected[r["group_id"]] for r in groups)
    assert len({r["group_id"] for r in groups}) <= len(set(expected.values())) + 2


@pytest.mark.parametrize("block", [1 << 9, 40])
def test_all_pairs_of_crowded_keys_are_found(spark, monkeypatch, block):
    """Groups are exact even if no fingerprints are near: keys of many sets, with many outside their largest group."""
    rnd = random.Random(15)
    passage, long = [f"p{i}" for i in range(104)], [f"l{i}" for i in range(600)]
    parts = [[f"q{k}x{i}" for i in range(9)] for k in range(6)]
    rows = []
    for i in range(290):
        picked = sorted(rnd.sample(range(6), 3))
        rows.append((i, " ".join([*passage, *(w for k in picked for w in parts[k]), *(f"u{i}x{j}" for j in range(12))]), "a"))
    for i in range(40):
        rows.append((len(rows), " ".join([*long, *(f"v{i}x{j}" for j in range(rnd.choice([50, 60, 66, 80, 120])))]), "a"))
    expected = brute.similar_groups({d: t for d, t, _ in rows})
    monkeypatch.setattr(simhash, "_WORD_BITS", -1)
    monkeypatch.setattr(simhash, "_BLOCK", block, raising=False)
    groups = simhash.similar_groups(documents(spark, rows)).collect()
    assert {r["first_id"]: r["group_id"] for r in groups} == expected
    assert 20 < len(set(expected.values())) < 60


@pytest.mark.parametrize("within", [True, False])
def test_pairs_of_blocks_match_a_plain_version(within):
    rng = np.random.default_rng(4)
    sets, share = [], Fraction(4, 5)
    for size in (5, 40, 500, 900, 1100, 2500):
        base = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        for _ in range(15):
            copy = base.copy()
            copy[rng.random(size) < rng.uniform(0, 0.3)] += np.uint64(1 << 40)
            sets.append(np.unique(np.append(copy, rng.integers(0, 1 << 64, rng.integers(1, 2 + size // 8), dtype=np.uint64))))
    root = [i if i % 4 else 8 for i in range(len(sets))]
    block = [0 if within else i % 2 for i in range(len(sets))]
    odd = [simhash._parities(x, simhash._odd_words(len(x))) for x in sets]
    assert len({len(x) for x in odd}) == 4
    for x, runs in zip(odd, sets, strict=True):
        assert (simhash._folded(x[None], 16)[0] == simhash._parities(runs)).all()
    crowd = pa.table({
        "node": range(len(sets)), "n": [len(x) for x in sets], "root": root, "block": block, "lo": [0] * len(sets),
        "hi": [int(not within)] * len(sets), "odd": pa.array([x.tolist() for x in odd], pa.list_(pa.int64())),
    })
    rows = [tuple(r.values()) for r in simhash._likely(crowd, share).to_pylist()]
    met, similar = set(), set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if root[i] != root[j] and (within or block[i] != block[j]):
                met.add((i, j))
                if 9 * len(np.intersect1d(a, sets[j])) >= 4 * (len(a) + len(sets[j])):
                    similar.add((i, j))
    assert len(rows) == len(set(rows)) and similar and similar <= set(rows) <= met and len(rows) < len(met) / 5


def test_links_within_a_group_are_followed_once(spark, monkeypatch):
    """Later rounds connect groups, not again all sets of a large group."""
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rnd.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy), "a"))
    given = []

    def counted(edges):
        given.append(edges.count())
        return components(edges)

    monkeypatch.setattr(simhash, "components", counted)
    groups = simhash.similar_groups(documents(spark, rows)).collect()
    assert {r["group_id"] for r in groups} == {0} and len(groups) == 150
    assert given[0] >= 149 and sum(given[1:]) < 149


def test_tested_pairs_do_not_come_up_again(spark):
    rows = [(i, " ".join([*(f"b{j}" for j in range(100)), f"x{i}"]), "a") for i in range(30)]
    sets = simhash._sets(documents(spark, rows).select("doc_id", "text"), 5, Fraction(4, 5))
    roots = sets.select("node", F.col("node").alias("root"))
    first = simhash._print_pairs(sets, roots, 2, False)
    tested = stored(first.limit(10))
    assert simhash._print_pairs(sets, roots, 2, False, tested=tested).count() == first.count() - 10


def test_stored_keeps_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}
    before = files()
    table = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 7


def test_stored_rows_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        sizes = stored(map_rows(spark.range(0, 9000, 1, 1), lambda batch: iter([{"n": [batch.num_rows]}]), "n int"))
        assert sizes.agg(F.max("n"), F.sum("n")).first() == (1024, 9000)
        assert spark.conf.get(key) == "10000"
    finally:
        spark.conf.set(key, before)


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    odd = ["a  b", " lead", "trail ", "it's  we'll\n\nx", "x y z", "<|endoftext|> a <|endoftext|>b", "\x00 \x1f", "Ünïcode 漢字 🎉", "a \n b", "#", "\u0085 q   r"]
    rows = odd_rows(5) + [(100 + i, t, "s") for i, t in enumerate(odd)]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_blocks(documents(spark, rows), path).collect()}
    at, expected = 0, {}
    for d, t, _ in sorted(rows):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == expected
    ties = tokens.token_blocks(documents(spark, [(None, "b", None), (1, "a", None), (1, "a", None)]), path).collect()
    assert sorted((r["start"], r["doc_id"]) for r in ties) == [(0, None), (2, 1), (4, 1)]
    assert tokens.token_blocks(documents(spark, []), path).count() == 0


def test_encoder_cuts_as_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    rnd = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\r", "a", "Bc", "é", "ß", "1", "²", "¼", "_", "-", "'s", "'ll", "'", ".", "<|endoftext|>", "<|end", "\x1c", "\x85",
             "\xa0", "\u2003", "日", "ǆ", "ª", "\xad", "😀", "\u0301", "x" * 70]
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        assert own.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_asks_the_library_once_for_each_unit():
    class Asked(list):
        def encode_batch_fast(self, texts, **kinds):
            self.extend(texts)
            return library.encode_batch_fast(texts, **kinds)

    own = tokens.Encoder(queries.tokenizer_path())
    library, own.tokenizer = own.tokenizer, Asked()
    texts = ["one " + " ".join(f"unit{k % 70}" + ".,!"[k % 3] for k in range(n)) for n in (40, 210, 210)] + ["x" * 99, None]
    found = own.encode(texts) + own.encode(texts)
    assert [x.tolist() for x in found] == [library.encode(t or "", add_special_tokens=False).ids for t in texts] * 2
    units = Counter(unit for text in own.tokenizer if text.startswith(" ") for unit in text.split())
    assert units == Counter({f"unit{k}": 1 for k in range(70)})
    assert own.tokenizer.count("x" * 99) == 2


def test_encoder_with_little_memory(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "_REMEMBERED", 20)
    monkeypatch.setattr(tokens, "_SLICE", 150)
    monkeypatch.setattr(tokens, "_JOINED", 3)
    path = queries.tokenizer_path()
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    rnd = random.Random(7)
    parts = ["a", "Bc", "é", "×", "1", ".", "...", "$$$", "'", "'s", "\n", "\x1c", "<|endoftext|>", "日", "😀", "\u0120", "y" * 70]
    units = ["".join(rnd.choices(parts, k=rnd.randrange(1, 4))) for _ in range(80)] + [""]
    for _ in range(60):
        texts = [rnd.choice([None, "", *[" ".join(rnd.choices(units, k=rnd.randrange(12))) for _ in range(9)]]) for _ in range(20)]
        assert [x.tolist() for x in own.encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pairs_and_their_places():
    rnd = np.random.default_rng(4)
    for top in (5, 70_000, 1 << 32):
        symbols = rnd.integers(top - 5, top, 500).astype(np.uint32)
        at = np.flatnonzero(rnd.random(499) < 0.7)
        left, right, counts, places = tokens._by_pair(symbols, at)
        expected = sorted((int(symbols[k]), int(symbols[k + 1]), int(k)) for k in at)
        assert list(zip(np.repeat(left, counts).tolist(), np.repeat(right, counts).tolist(), places.tolist())) == expected


def test_repair_goes_on_to_the_least_count():
    rnd = np.random.default_rng(3)
    ids = (rnd.zipf(1.3, 60_000) % 5_000).astype(np.uint32)
    ends = np.arange(100, len(ids) + 1, 100)
    symbols, rules, symbol_ends = tokens.repair(ids, ends, 5_000)
    assert (tokens.expand(symbols, rules, 5_000) == ids).all()
    last = set((symbol_ends - 1).tolist())
    left = Counter((int(a), int(b)) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if k not in last)
    assert len(rules) and max(left.values()) < 32


def test_repair_blocks():
    rnd = np.random.default_rng(1)
    phrase = rnd.integers(0, 50, 30)
    ids = np.concatenate([np.concatenate((phrase, rnd.integers(0, 50, 10), [7] * 9)) for _ in range(400)]).astype(np.uint32)
    ends = np.arange(49, len(ids) + 1, 49)
    symbols, rules, symbol_ends = tokens.repair(ids, ends, 50)
    assert len(symbols) < len(ids) / 3 and (tokens.expand(symbols, rules, 50) == ids).all()
    lengths = tokens.expansion_lengths(rules, 50)
    for k in (0, 7, 399):
        own = symbols[(symbol_ends[k - 1] if k else 0) : symbol_ends[k]]
        assert (tokens.expand(own, rules, 50) == ids[49 * k : 49 * k + 49]).all()
    for a, b in ((0, 1), (100, 171), (len(ids) - 3, len(ids))):
        assert (tokens.decode_slice(symbols, rules, lengths, 50, a, b) == ids[a:b]).all()


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 5, 40, 300])), rnd.choice(["a", "a", "a", "b", "ç", "d", None])) for i in range(600)]
    rows += [(1000, None, "e"), (None, "x y", "a"), (5, rows[5][1], rows[5][2])]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else left * weight[s] / sum(weight[x] for x in open_)
        left -= sum(3.0 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(spark, rows[::-1])).collect()))
    repeated = mixing.mixed(documents(spark, rows))
    assert repeated.columns == documents(spark, []).columns and repeated.count() == sum(r["copies"] for r in got)
    assert mixing.mix(documents(spark, [])).count() == 0


def test_balance_of_two_columns(spark):
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 20.0), (None, "y", 40.0), (None, "x", 1.0)], "s string, l string, mass double")
    targets = {
        "s": spark.createDataFrame([("a", 60.0), ("b", 10.0), (None, 30.0)], "s string, target double"),
        "l": spark.createDataFrame([("x", 45.0), ("y", 55.0)], "l string, target double"),
    }
    got = mixing.balance(cells, targets, 1e-6).toPandas()
    got["words"] = got["mass"] * got["rate"]
    assert got.groupby("l")["words"].sum().round(2).tolist() == [45, 55] and got.groupby("s", dropna=False)["words"].sum().round(2).tolist() == [60, 10, 30]


def test_leaks(spark):
    rnd = random.Random(8)
    letters = "abcdefgh ij"
    items = [(i, "".join(rnd.choices(letters, k=rnd.choice([30, 80, 150])))) for i in range(6)] + [(6, None), (7, ""), (None, "abc def ghi"), (8, "ab")]

    def changed(text, edits):
        chars = list(text)
        for _ in range(edits):
            at = rnd.randrange(len(chars))
            chars[at : at + 1] = rnd.choice([[], ["z"], [chars[at], "y"]])
        return "".join(chars)

    rows = [(0, None, None), (1, "", None)]
    for i in range(2, 40):
        text = "".join(rnd.choices("klmnop qr", k=rnd.choice([5, 200, 2000])))
        if i % 2:
            text = text[:100] + changed(items[i % 6][1].upper(), rnd.choice([0, 3, 8, 14, 20])) + text[100:]
        rows.append((i, text, None))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = set()
    for d, t, _ in rows:
        for i, item in items:
            if i is not None and leaks.normal(item):
                n = leaks.normal(item)
                e = brute.substring_distance(n, leaks.normal(t))
                if e <= leaks.budget(len(n), 0.1):
                    expected.add((d, i, e))
    assert {tuple(r)[:3] for r in leaks.leaks(documents(spark, rows), benchmark).collect()} == expected and len(expected) > 10
    assert {tuple(r)[:3] for r in leaks.leaks(documents(spark, rows), benchmark, block_chars=100).collect()} == expected
    assert leaks.leaks(documents(spark, rows), benchmark.limit(0)).count() == 0 == leaks.leaks(documents(spark, []), benchmark).count()


def test_toxic_automaton():
    terms = [("moron", False), ("pathetic", False), ("scum", False), ("lowe", True)]
    lexicon = toxic.Lexicon(terms)
    rnd = random.Random(0)
    tried = ["moron", "scum", "scun", "lowexyz", "low", "", "m", "pathetically"]
    for _ in range(4000):
        word = list(rnd.choice(["moron", "pathetic", "scum", "other"]))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(word) + 1)
            word[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "o"])
        tried.append("".join(word))
    for word in tried:
        found = [brute.levenshtein(word, t) for t, stem in terms if not stem and brute.levenshtein(word, t) <= lexicon.bound(len(t))]
        expected = 0 if word.startswith("lowe") else min(found, default=None)
        assert lexicon.find(word) == expected, word


def test_quotation():
    assert toxic.quoted('he wrote "what a moron" there'.split(), 4) and toxic.quoted("she said moron".split(), 2)
    assert not toxic.quoted('"fine" but you are a moron anyway'.split(), 5) and not toxic.quoted("you moron".split(), 1)


def test_toxicity(spark):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        tokens_ = rnd.choices([f"w{k}" for k in range(300)], k=30) + (rnd.choices(["scumbag", "lunatic", "vermin"], k=3) if bad else [])
        rnd.shuffle(tokens_)
        rows.append((i, " ".join(tokens_), None))
        labels.append((i, None, int(bad)))
    odd = [(1000, None, None), (1001, "", None), (1002, "you scumbbag and vermim and lunattic", None), (None, "w1", None), (5, rows[5][1], None)]
    labels += [(None, None, 1), (7, None, None), (8, None, 9)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + odd)
    got = toxic.score(docs, table).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert all(by_id[i]["predicted"] == (i % 4 == 0) for i in range(400) if by_id[i]["held_out"])
    assert by_id[1000]["predicted"] == by_id[1001]["predicted"] == 0 and by_id[1002]["near_hits"] == 3
    clean = toxic.without_toxic(docs, table)
    assert clean.columns == docs.columns and clean.count() == sum(r["predicted"] == 0 for r in got)
    assert {r["score"] > 0.5 for r in toxic.score(docs, table.where("false")).collect()} == {False}
    assert toxic.score(documents(spark, []), table).count() == 0


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got) / len(got)
    caught = [r["predicted"] for r in got if r["toxic"]]
    assert right >= 0.97 and sum(caught) / len(caught) >= 0.8
