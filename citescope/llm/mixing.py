"""Mixing sources to target weights: entropy balancing of document rates, rounded into whole copies."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Documents of one size and source that one task ranks at most; larger cells are split by hash.
SLICE = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above `cap` times its source.

    Sources in code point order, NULL last, weigh `weights`, repeated. Excess of capped sources is shared by weight
    among the others until none is above: target = min(cap * size, level * weight) at the level where the targets add
    up to the total. Sources whose cap is lowest for their weight are capped first, so one sorted pass finds it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), (place + 1).cast("int")))
    limit = cap * F.col("source_size")
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = (
        weighed.withColumn("ratio", limit / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # The first source in this order that the level of the rest doesn't push above its cap ends the capped ones.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return levels.select(
        "source", "source_size", F.least(limit, F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target")
    )


def balance(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """Add `rate` to `cells` (one row per combination of the columns in `targets`, with its words in `mass`).

    `targets[column]` has (column, target): the words that rows with this value shall contribute. Of all rates that
    meet the targets these stay closest to 1 (least relative entropy, counted in words). They are exponential tilts
    exp(sum of one multiplier per column); the multipliers minimise the convex dual. A column's multipliers touch
    disjoint rows, so its block of the Hessian is diagonal: one aggregation gives gradient and Hessian of all values
    at once, and a Newton step is a join, without anything but the largest residual at the driver. Columns take turns.
    """
    now = stored(cells.withColumn("tilt", F.lit(0.0)))
    for _ in range(rounds):
        worst = 0.0
        for column, target in targets.items():
            sums = now.groupBy(column).agg(F.sum(F.col("mass") * F.exp("tilt")).alias("_now"))
            goal = target.select(F.col(column).alias("_value"), F.col("target").alias("_target"))
            steps = sums.join(goal, sums[column].eqNullSafe(goal["_value"])).select(
                F.col("_value"), F.when(F.col("_now") > 0, F.col("_target") / F.col("_now") - 1).otherwise(0.0).alias("_gap")
            )
            steps = stored(steps)
            found = steps.agg(F.max(F.abs("_gap"))).first()[0]
            worst = max(worst, found or 0.0)
            step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_gap")))
            now = stored(
                now.join(steps, now[column].eqNullSafe(steps["_value"]), "left")
                .withColumn("tilt", F.col("tilt") + F.coalesce(step, F.lit(0.0)))
                .drop("_value", "_gap")
            )
        if worst <= tolerance:
            break
    return now.withColumn("rate", F.exp("tilt")).drop("tilt")


def _copies_of_cells(cells: DataFrame, cap: float) -> DataFrame:
    """Whole copies for every (source, size) cell: large documents first, what they miss is made up by smaller ones.

    One task sees a source's distinct sizes, not its documents.
    """

    def per_source(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ascending=False, kind="stable")
        goal = taken = 0.0
        copies = []
        for size, n, rate in zip(frame["size"], frame["n"], frame["rate"], strict=True):
            goal += size * n * rate
            want = round((goal - taken) / size) if size else round(n * rate)
            want = int(min(max(want, 0), int(cap) * n))
            taken += want * size
            copies.append(want)
        return frame.assign(copies=copies)[["source", "size", "n", "copies"]]

    return cells.groupBy("source").applyInPandas(per_source, "source string, size long, n long, copies long")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Whole copies of every document so that each source's words come near its target.

    One row per input row: row (names it by content), doc_id, source, size (words; 0 for a missing text), source_size,
    target (of its source), copies. NULL is a source of its own. Documents of a source and size share the cell's copies
    evenly; who gets one more is decided by the hash of doc_id, so reruns agree and ties are equal. No row gets more
    than `cap` copies. Texts without words keep their copies but add no words; if a source has no words its rows stay
    once. An empty table gives an empty result; other columns are ignored.
    """
    id_ = F.col("doc_id").cast("long")
    sizes = stored(
        docs.select(
            F.xxhash64(id_, "source", "text").alias("row"), id_.alias("doc_id"), F.col("source").cast("string"),
            size_of(F.col("text")).alias("size"),
        )
    )
    targets = stored(source_targets(sizes, weights, cap))
    cells = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    by_source = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("mass"))
    rates = balance(by_source, {"source": targets})
    rated = cells.join(rates.select(F.col("source").alias("_s"), "rate"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = _copies_of_cells(rated.select("source", "size", "n", F.least("rate", F.lit(cap)).alias("rate")), cap)
    whole = stored(whole.withColumn("parts", F.ceil(F.col("n") / SLICE)))

    def with_cells(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        on = [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
        return left.join(renamed, on).drop(*[f"_{k}" for k in keys])

    hashed = F.xxhash64(F.lit("mix"), "doc_id")
    sliced = with_cells(sizes, whole, "source", "size").withColumn("hash", hashed).withColumn("part", F.pmod("hash", "parts"))
    parts = sliced.groupBy("source", "size", "part").agg(F.count("*").alias("own"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    upto = F.sum("own").over(Window.partitionBy("source", "size").orderBy("part"))
    extra = F.col("copies") % F.col("n")
    shared = parts.withColumn("_upto", upto).select(
        "source", "size", "part",
        (F.floor(extra * F.col("_upto") / F.col("n")) - F.floor(extra * (F.col("_upto") - F.col("own")) / F.col("n"))).alias("more"),
    )
    ranked = with_cells(sliced, shared, "source", "size", "part").withColumn(
        "rank", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("hash", "doc_id", "row"))
    )
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("rank") <= F.col("more")).cast("long")
    decided = ranked.select("row", "doc_id", "source", "size", copies.alias("copies"))
    return with_cells(decided, targets, "source").select("row", "doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The mix itself: every document as often as it has copies, all columns."""
    copies = mix(docs, weights, cap).groupBy("row").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    named = docs.withColumn("row_", F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text"))
    once = named.join(copies, named["row_"] == copies["row"]).dropDuplicates(["row_"])
    repeated = once.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return repeated.select(*[docs[c] for c in docs.columns])
