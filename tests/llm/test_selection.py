"""Fill-in-middle, importance resampling and exact top-k search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from citescope.llm import fim, resampling, topk
from citescope.llm.common import stored
from test_documents import documents, odd_rows

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def lined_rows():
    rnd = random.Random(5)
    passage = "\n".join(" ".join(rnd.choices(["日本", "w", "naïve", "<", "<P", "S>"], k=30)) for _ in range(12))
    rows = [(0, None, "a"), (1, "", "a"), (2, "\n", None), (3, "\n\n\n", "b"), (4, "one", None), (5, "x\ny", "a"), (6, "a<P>b", "a")]
    rows += [(7, "q" * 4094 + "<M>" + "\n" * 3, "a"), (8, "<\nP>" * 900, "a"), (9, " " * 70_000 + "\nend", "a"), (None, passage, "a")]
    for i in range(10, 70):
        lines = [" ".join(rnd.choices(["alpha", "βήτα", "\r", " ", "𝒳"], k=rnd.randrange(40))) for _ in range(rnd.randrange(60))]
        rows.append((i, "\n".join([*lines, passage, *lines[: i % 3]]) + "\n" * (i % 2), "a"))
    return rows + [rows[20], rows[20]]


def test_fill_in_middle(spark):
    rows = lined_rows()
    found = fim.fill_in_middle(documents(spark, rows))
    got = found.withColumn("back", fim.restored(found["output"], found["form"])).collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter(
        (d, *plain_fim(d, t)) for d, t, _ in rows
    )
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((d, t or "") for d, t, _ in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    some = fim.fill_in_middle(documents(spark, rows), seed=1, rate=40, spm_rate=0).collect()
    assert Counter((r["doc_id"], r["form"]) for r in some) == Counter((d, plain_fim(d, t, 1, 40, 0)[1]) for d, t, _ in rows)
    assert fim.fill_in_middle(documents(spark, [])).count() == 0


def test_chunks_are_set_by_content():
    rnd = random.Random(2)
    shared = rnd.randbytes(60_000)
    cuts = []
    for before in (b"", rnd.randbytes(777), rnd.randbytes(5001)):
        data = before + shared
        ends = fim.chunk_ends(data)
        assert ends[-1] == len(data) and all(b - a <= 4096 for a, b in zip([0, *ends], ends, strict=False))
        cuts.append({hashlib.sha256(data[a:b]).digest() for a, b in zip([0, *ends], ends, strict=False)})
    # Only the chunks next to what differs are new.
    assert all(len(cuts[0] - other) <= 3 for other in cuts[1:]) and len(cuts[0]) > 60


def test_memory_of_chunks_is_bounded():
    memory = fim.Memory(5000)
    for i in range(200):
        chunk = b"%d\n" % i * 100
        assert memory.of(chunk) == fim.summary(chunk)
        assert sum(map(len, memory._known)) == memory._bytes <= 5000


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_resample(rows, target, percent=10, n=1, buckets=10_000, least=20, seed=2024):
    def features(text):
        w = plain_words(text)
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)))
    for text in target:
        t.update(map(bucket, features(text)))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * big_s) / ((s[b] + 1) * big_t))) for b in range(buckets)}
    out = []
    for d, text in rows:
        f = features(text)
        h = int(sha(f"{seed}:{'' if d is None else d}")[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(plain_words(text))])
    pool = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(pool[: len(pool) * percent // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("percent", "n", "buckets", "segment_rows"), [(10, 1, 10_000, 1_000_000), (60, 2, 50, 7), (100, 1, 3, 1)])
def test_resampling(spark, percent, n, buckets, segment_rows):
    rows = odd_rows(9, 150)
    rows += [(None, rows[20][1], "a"), *[rows[30]] * 60, (500, "ÀB cd É0 '" * 30, None)]
    target = [rows[8][1], "w1 w2 w3 W4", None, ""]
    got = resampling.resample(
        documents(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"),
        percent, n, buckets, segment_rows=segment_rows,
    )
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_resample([(d, t) for d, t, _ in rows], target, percent, n, buckets)


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(documents(spark, []), empty).count() == 0
    rows = [(1, None, "a"), (2, "a b", "a")]
    assert Counter(map(tuple, resampling.resample(documents(spark, rows), empty).collect())) == plain_resample([r[:2] for r in rows], [])


def test_segments_stay_even_with_one_hot_key(spark):
    """A third of all rows with one score and id: the number of the row splits them."""
    n = 9000
    rows = spark.range(n).selectExpr(
        "if(id % 3 = 0, 7, id) doc_id", "1L n_features", "0L weight", "if(id % 3 = 0, 50, id % 90) score", "true eligible",
        "-if(id % 3 = 0, 50, id % 90) falling", "if(id % 3 = 0, 7, id) ordinal", "id row",
    )
    rows = stored(rows.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in resampling.SCORED.split(", ")]).repartition(6))
    runs = rows.rdd.getNumPartitions()
    splitters = resampling._splitters(rows, 10, n // (resampling.SAMPLES * max(10, runs)))
    sizes = [r["count"] for r in resampling._with_segment(rows, splitters).groupBy("segment").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == n and max(sizes) <= 1.5 * n / 10
    ranks = resampling.ranked(rows, 4000, segment_rows=500).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 4001))
    keys = [(r["falling"], r["ordinal"]) for r in ranks]
    assert keys == sorted((r["falling"], r["ordinal"]) for r in rows.collect())[:4000]


def plain_top(rows, k, every):
    table = [
        (i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in table if i % every == 0}):
        mine = min(v for i, v in table if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v, strict=False)), i) for i, v in table if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def vector_rows(scale=1.0, n=400, dims=24, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dims))
    rows = [(i, [float(np.float32(x)) for x in scale * (centres[i % 6] * (i % 5) + rnd.normal(size=dims) / 4)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(7, rows[9][1]), (20, rows[5][1]), (20, rows[20][1])]  # repeated ids
    nan, inf = float("nan"), float("inf")
    return rows + [(None, rows[1][1]), (1000, None), (1010, [None] * dims), (1020, [nan] * dims), (1030, [inf, *rows[0][1][1:]]), (1040, []), (1050, rows[2][1][:5]), (1060, [0.0] * dims)]


@pytest.mark.parametrize(("scale", "k", "rows", "queries", "per_slice"), [(1.0, 10, 64, 8, 2), (1e-4, 3, 4096, 1024, 8), (3e4, 10, 100, 4, 1), (1.0, 1000, 50, 1024, 3)])
def test_top_k(spark, scale, k, rows, queries, per_slice):
    data = vector_rows(scale)
    df = spark.createDataFrame([(i, v, "q") for i, v in data], "vec_id long, embedding array<float>, score string").coalesce(2)
    got = topk.top_k(df, k, 10, rows=rows, queries=queries, per_slice=per_slice)
    assert sorted(map(tuple, got.collect())) == plain_top(data, k, 10)


def test_top_k_of_long_vectors(spark):
    data = [(i, [x * 1e6 for x in v]) for i, v in vector_rows(1e-3, 60, 4) if v is not None and None not in v]
    data.append((300, [1e30] * 4))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, 5, 10).collect())) == plain_top(data[:-1], 5, 10)
    assert topk.top_k(spark.createDataFrame([], df.schema)).count() == 0


def test_branch_and_bound_prunes():
    """Survivors are few where a few candidates stand out, and the best are among them."""
    rnd = np.random.default_rng(4)
    query = np.rint(rnd.normal(size=64) * 100)
    cells = np.rint(rnd.normal(size=(4000, 64)) * 20)
    cells[:12] += query
    block = topk.Block(4000, 64, np.arange(4000).tobytes(), cells.T.astype("<i4").tobytes(), 8, np.float64)
    ids, scores, least = topk.search(query, -1, block, 10, -np.inf, 8)
    exact = cells @ query
    assert len(ids) < 100 and dict(zip(ids.tolist(), scores.tolist(), strict=True)) == {i: exact[i] for i in ids.tolist()}
    assert set(np.argsort(-exact)[:10].tolist()) <= set(ids.tolist()) and least <= np.sort(exact)[-10]
