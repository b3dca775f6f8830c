"""Line dedup with DataFrame functions only: exact copies by hash, near copies by a segment-partition edit join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import WORD, stored

#: Lines that share one segment key before finer keys take over.
BUSY = 16
#: Blocks of the finer keys.
BLOCKS = 16


def segment_bounds(length: Column, k: int, parts: int) -> tuple[Column, Column]:
    """(start, size) of segment k of `parts`, counted from 0."""
    start = F.floor(length * k / parts).cast("int")
    return start, F.floor(length * (k + 1) / parts).cast("int") - start


def _piece(line: Column, start: Column, size: Column) -> Column:
    return F.substring(line, start + 1, size)


def index_keys(line: Column, edits: int) -> Column:
    """One key per segment: line length, segment number and the segment's text."""
    length = F.char_length(line)
    parts = [segment_bounds(length, k, edits + 1) for k in range(edits + 1)]
    return F.array(*[F.xxhash64(length, F.lit(k), _piece(line, *part)) for k, part in enumerate(parts)])


def probe_keys(line: Column, edits: int) -> Column:
    """Keys under which a line of the same or a smaller length is found if it is within `edits`.

    A segment that survives unchanged has moved by no more than the edits before it, and what follows it by no more
    than the edits after it; only these places are probed.
    """
    length = F.char_length(line)
    keys = []
    for shorter in range(edits + 1):
        other = length - shorter
        for k in range(edits + 1):
            start, size = segment_bounds(other, k, edits + 1)
            for move in range(max(-k, shorter - (edits - k)), min(k, shorter + edits - k) + 1):
                keys.append(F.xxhash64(other, F.lit(k), _piece(line, start + move, size)))
    return F.array_distinct(F.array(*keys))


def finer_index_keys(line: Column) -> Column:
    """Everything but one block: its number, the text before and the text after it."""
    return _around(line, 0)


def finer_probe_keys(line: Column) -> Column:
    return F.array_distinct(F.concat(_around(line, 0), _around(line, 1)))


def _around(line: Column, longer: int) -> Column:
    """Keys of a line as one that is `longer` characters longer than the line whose blocks are cut. One edit is inside one block."""
    length = F.char_length(line)
    other = length - longer
    keys = []
    for k in range(BLOCKS):
        start, size = segment_bounds(other, k, BLOCKS)
        after = start + size + longer
        keys.append(F.xxhash64(other, F.lit(k), _piece(line, F.lit(0), start), _piece(line, after, length - after)))
    return F.array(*keys)


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters if it is at most `edits`, else something larger.

    Bit-parallel columns of the band |row - column| <= edits: bit k of column j is row j - edits + k. The score runs
    down the band's lowest diagonal until the last row is reached, then along that row. Both arrays must have at least
    `edits` characters and differ by at most `edits` in length.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def step(state: Column, j: Column) -> Column:
        char = F.get(b, j - 1)
        bits = [F.when(F.get(a, j - 1 - edits + k) == char, F.lit(1 << k)).otherwise(0) for k in range(width)]
        matches = reduce(lambda x, y: x + y, [F.coalesce(x, F.lit(0)) for x in bits])

        def columns(x: Column) -> Column:
            vp, vn = state["vp"], state["vn"]
            d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def after(d: Column) -> Column:
                hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d.bitwiseOR(vp)))
                hn = d.bitwiseAND(vp)
                down = F.shiftright(d, 1)
                row = F.size(a) - j + edits  # bit of the last row in this column
                diagonal = F.when(d.bitwiseAND(F.lit(1 << (width - 1))) > 0, 0).otherwise(1)
                along = F.call_function("shiftright", hp, row).bitwiseAND(F.lit(1)) - F.call_function("shiftright", hn, row).bitwiseAND(F.lit(1))
                return F.struct(
                    hn.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(hp))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (state["score"] + F.when(row >= width - 1, diagonal).otherwise(along)).alias("score"),
                )

            return let(d0, after)

        # The last row has at most 2 * edits columns left to lower the score by 1 each: what is above needs no more.
        return F.when(state["score"] > 3 * edits, state).otherwise(let(matches, columns))

    begin = F.struct(
        F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("score")
    )
    return F.aggregate(F.sequence(F.lit(1), F.size(b)), begin, step, lambda s: s["score"])


def _documents(docs: DataFrame) -> DataFrame:
    """`row` names a row by its content; `rank` puts rows without doc_id last."""
    id_ = F.col("doc_id").cast("long")
    return docs.select(
        F.xxhash64(id_, "text").alias("row"), id_.alias("doc_id"),
        F.coalesce(id_, F.lit((1 << 63) - 1)).alias("rank"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"),
    )


def _first_lines(documents: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(rank, row, line, index, probe): the first line of every distinct text, with its segment keys. Stored.

    One pass over the texts: equal lines are summed up per task before the shuffle, and only hashes travel. Lines
    without a word are left out; lines shorter than `min_chars` have no keys.
    """
    text = F.col("text")
    long = F.char_length("text") >= min_chars
    none = F.array().cast("array<bigint>")
    occurrences = documents.select("rank", "row", F.posexplode("lines").alias("line", "text")).where(text.rlike(WORD))
    keyed = occurrences.select(
        F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"),
        F.struct(
            "rank", "row", "line", F.when(long, index_keys(text, edits)).otherwise(none).alias("index"),
            F.when(long, probe_keys(text, edits)).otherwise(none).alias("probe"),
        ).alias("first"),
    )
    return stored(keyed.groupBy("a", "b").agg(F.min("first").alias("first")).select("first.*"))


def _texts_of(documents: DataFrame, places: DataFrame) -> DataFrame:
    """(row, line, text) of some lines. `places` is a stored table of (row, line): its size decides how it is joined."""
    wanted = places.groupBy("row").agg(F.collect_set("line").alias("wanted")).withColumnRenamed("row", "_row")
    found = documents.join(stored(wanted), F.col("row") == F.col("_row")).select("row", F.explode("wanted").alias("line"), "lines")
    return found.select("row", "line", F.get("lines", F.col("line")).alias("text")).dropDuplicates(["row", "line"])


def near_lines(documents: DataFrame, first: DataFrame, edits: int) -> DataFrame:
    """(row, line) of first lines that are within `edits` of an earlier first line."""
    place = F.struct("rank", "row", "line")
    index = first.select(place.alias("at"), F.explode("index").alias("key"))
    probe = first.select(place.alias("by"), F.explode("probe").alias("key"))
    if edits == 1:
        busy = stored(index.groupBy("key").count().where(F.col("count") > BUSY).select("key"))
        crowded = stored(
            index.join(busy, "key", "left_semi").select(F.col("at").alias("p"))
            .unionByName(probe.join(busy, "key", "left_semi").select(F.col("by").alias("p")))
            .distinct().select("p.*")
        )
        lines = _texts_of(documents, crowded.select("row", "line")).join(crowded, ["row", "line"])
        fine = stored(lines.select(place.alias("at"), finer_index_keys(F.col("text")).alias("index"), finer_probe_keys(F.col("text")).alias("probe")))
        found = index.join(busy, "key", "left_anti").join(probe.join(busy, "key", "left_anti"), "key").select("at", "by").unionByName(
            fine.select("at", F.explode("index").alias("key"))
            .join(fine.select(F.col("at").alias("by"), F.explode("probe").alias("key")), "key").select("at", "by")
        )
    else:
        found = index.join(probe, "key").select("at", "by")
    pairs = stored(
        found.where("at <> by").select(F.least("at", "by").alias("early"), F.greatest("at", "by").alias("late")).distinct()
    )
    wanted = pairs.select(F.explode(F.array("early", "late")).alias("p")).distinct().select("p.row", "p.line")
    texts = stored(_texts_of(documents, wanted).select("row", "line", F.split("text", "").alias("chars")))
    named = [texts.select(*[F.col(c).alias(f"{side}_{c}") for c in texts.columns]) for side in ("e", "l")]
    both = pairs.join(named[0], (F.col("early.row") == F.col("e_row")) & (F.col("early.line") == F.col("e_line"))).join(
        named[1], (F.col("late.row") == F.col("l_row")) & (F.col("late.line") == F.col("l_line"))
    )
    close = both.where(
        (F.abs(F.size("e_chars") - F.size("l_chars")) <= edits)
        & (banded_distance(F.col("e_chars"), F.col("l_chars"), edits) <= edits)
    )
    return close.select("late.row", "late.line").distinct()


def duplicate_lines(docs: DataFrame, edits: int = 1, min_chars: int = 20) -> DataFrame:
    """Lines to remove from every document: repeats of an earlier line, exactly or within `edits` edits.

    Order is doc_id, then line number. A line goes if an earlier line has the same text, or if an earlier line of
    another text is within `edits` insertions, deletions or changes and both have at least `min_chars` characters
    (at least 2 * edits + 2). Earlier lines count whether they stay themselves or not. Lines without a word stay and
    remove none.

    Returns one row per input row: doc_id, n_lines, n_exact, n_near (lines removed of either kind), removed (line
    numbers from 0, ascending). Missing and empty texts are one line without a word. Rows without doc_id come last;
    rows that repeat a doc_id and text are one document. An empty table gives an empty result; other columns are
    ignored. Texts of keys shared by more than `BUSY` lines are keyed again by all but one of 16 blocks (one edit lies
    in one block), so variants of one line that differ in more than one place are never paired.
    """
    if min_chars < 2 * edits + 2:
        raise ValueError("min_chars must be at least 2 * edits + 2")
    documents = _documents(docs)
    first = _first_lines(documents, edits, min_chars)
    near = near_lines(documents, first, edits).groupBy("row").agg(F.collect_set("line").alias("near"))
    none = F.array().cast("array<int>")
    wordy = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get(F.col("lines"), i).rlike(WORD))
    own = first.groupBy("row").agg(F.collect_list("line").alias("own"))
    joined = (
        documents.select("row", "doc_id", F.size("lines").cast("long").alias("n_lines"), wordy.alias("wordy"))
        .join(own, "row", "left")
        .join(near, "row", "left")
        .withColumn("exact", F.array_except("wordy", F.coalesce("own", none)))
        .withColumn("near", F.coalesce("near", none))
    )
    return joined.select(
        "doc_id", "n_lines", F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"),
        F.sort_array(F.concat("exact", "near")).alias("removed"),
    )


def without_lines(docs: DataFrame, edits: int = 1, min_chars: int = 20) -> DataFrame:
    """The documents with their duplicate lines taken out, all columns. Rows without doc_id stay as they are."""
    removed = duplicate_lines(docs, edits, min_chars).where("doc_id is not null").groupBy("doc_id").agg(F.first("removed").alias("_removed"))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains("_removed", i))
    text = F.when(F.size("_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return docs.join(removed, "doc_id", "left").withColumn("text", text).select(docs.columns)
