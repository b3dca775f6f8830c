"""Exact top-k by inner product: branch and bound over vectors stored by dimension.

Candidates lie in blocks of rows, each cut into slabs of dimensions (vertical layout) with the squared mass of every row in
every slab. A query reads the slabs in the order of its own mass. After a slab, a candidate's score lies within its partial
sum plus or minus the root of the masses that both still have ahead (Cauchy-Schwarz). The k-th best lower bound so far prunes
all candidates whose upper bound is below it, and the survivors are compacted before the next slab is read.

Queries lie in blocks too. A cell is one block of queries with a slice of at most SLICE candidate blocks; cells are dealt by
hash, and each gives k rows per query. Both sides of a cell are bounded, so is its memory, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ROWS, SLAB, QUERIES, SLICE = 4096, 8, 1024, 8
_BLOCKS = "block long, n int, dims int, ids binary, cells binary, most double"


def whole_vectors(vectors: DataFrame, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): components times `scale`, rounded down. Rows that take no part are left out (see `top_k`)."""
    values = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col(key).cast("long").alias("id"), values.alias("v")).where(length < 2.0**62)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones filled with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    dims = int(lengths.max(initial=0))
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return out


def blocks(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """Candidate blocks: ids, and the components dimension by dimension as 32-bit integers."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def made() -> pa.RecordBatch:
            dims = max(p.shape[1] for p in parts)
            whole = np.zeros((held, dims), np.int64)
            at = 0
            for p in parts:
                whole[at : at + len(p), : p.shape[1]] = p
                at += len(p)
            most = float((whole.astype(float) ** 2).sum(1).max(initial=0))
            row = [number, held, dims, np.concatenate(ids).tobytes(), whole.T.astype("<i4").tobytes(), most]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=_BLOCKS.replace(",", "").split()[::2])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - held)
                ids.append(part["id"].to_numpy())
                parts.append(_matrix(part["v"]))
                at, held = at + part.num_rows, held + part.num_rows
                if held == size:
                    yield made()
                    number, ids, parts, held = number + 1, [], [], 0
        if held:
            yield made()

    return rows.mapInArrow(build, _BLOCKS)


class Block:
    """Slabs of a candidate block with their masses."""

    def __init__(self, n: int, dims: int, ids: bytes, cells: bytes, slab: int, kind: type) -> None:
        self.ids = np.frombuffer(ids, "<i8")
        whole = np.frombuffer(cells, "<i4").reshape(dims, n).astype(kind)
        self.slabs = [whole[a : a + slab] for a in range(0, dims, slab)]
        self.mass = [(s.astype(float) ** 2).sum(0) for s in self.slabs]
        self.total = sum(self.mass, np.zeros(n))


def search(query: np.ndarray, own: int, block: Block, k: int, least: float, slab: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(ids, scores, new lower bound) of the candidates that can be among the k best; `least` is the bound so far."""
    pieces = [query[a : a + slab] for a in range(0, slab * len(block.slabs), slab)]
    mass = np.array([(p.astype(float) ** 2).sum() for p in pieces])
    alive = np.flatnonzero(block.ids != own)
    if not len(alive):
        return block.ids[:0], np.zeros(0, np.int64), least
    score, ahead, mine = np.zeros(len(alive), query.dtype), block.total[alive], mass.sum()
    for s in np.argsort(-mass, kind="stable"):
        part = block.slabs[s][: len(pieces[s])]
        score = score + pieces[s][: len(part)] @ (part if len(alive) == part.shape[1] else part[:, alive])
        mine, ahead = max(0.0, mine - mass[s]), np.maximum(0, ahead - block.mass[s][alive])
        partial = score.astype(float)
        # Slack for the rounding of masses and, beyond 2**53, of scores.
        reach = np.sqrt(mine * ahead) * (1 + 1e-9) + 1 + np.abs(partial) * 1e-12
        if len(alive) > k:
            low = partial - reach
            least = max(least, float(np.partition(low, len(low) - k)[len(low) - k]))
        kept = partial + reach >= least
        if not kept.all():
            alive, score, ahead = alive[kept], score[kept], ahead[kept]
            if not len(alive):
                break
    return block.ids[alive], score.astype(np.int64), least


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


def _cell(k: int, slab: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if candidates.num_rows and queries.num_rows:
            ids, matrix = queries["id"].to_numpy(), _matrix(queries["v"].combine_chunks())
            longest = (matrix.astype(float) ** 2).sum(1).max(initial=0) * max(candidates["most"].to_pylist())
            # Doubles hold every sum exactly while no product of lengths reaches 2**53.
            kind = np.float64 if longest < 2.0**104 else np.int64
            dims = max(candidates["dims"].to_pylist())
            wide = np.zeros((len(ids), max(dims, matrix.shape[1])), kind)
            wide[:, : matrix.shape[1]] = matrix
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf) for _ in ids]
            for row in candidates.to_batches(1):
                cells = [row[c][0].as_py() for c in ("n", "dims", "ids", "cells")]
                block = Block(*cells, slab, kind)
                for i, own in enumerate(ids):
                    got, scores, least = search(wide[i], own, block, k, found[i][2], slab)
                    best = _best(np.concatenate([found[i][0], got]), np.concatenate([found[i][1], scores]), k)
                    full = float(best[1][-1]) * (1 - 1e-12 * np.sign(best[1][-1])) - 1 if len(best[0]) == k else -np.inf
                    found[i] = (*best, max(least, full))
            for own, (got, scores, _) in zip(ids, found, strict=True):
                for column, values in zip(out, (np.full(len(got), own), got, scores), strict=True):
                    column.append(values)
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, key: str = "vec_id", vector: str = "embedding",
    rows: int = ROWS, slab: int = SLAB, queries: int = QUERIES, per_slice: int = SLICE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row whose id is divisible by `every`.

    Candidates are all rows with another id, ties go to the smaller id; fewer rows than k give them all. Vectors that are null
    or hold null or non-finite components, and rows without an id, take no part; nor do vectors whose scaled length reaches
    2**31, as their products might not fit a long. A shorter vector counts as filled with zeros. Repeated rows each count as
    candidates; of query rows with one id the least vector counts. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, scale, key, vector)
    layout = stored(blocks(whole, rows))
    asked = stored(whole.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    n_blocks, n_queries = layout.count(), asked.count()
    q_blocks = max(1, -(-n_queries // queries))
    slices = max(1, -(-n_blocks // per_slice), min(n_blocks, spark.sparkContext.defaultParallelism))

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = layout.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).withColumn("part", numbers(q_blocks))
    right = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).withColumn("slice", numbers(slices))
    found = left.groupBy("part", "slice").cogroup(right.groupBy("part", "slice")).applyInArrow(
        _cell(k, slab), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
