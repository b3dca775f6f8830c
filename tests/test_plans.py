"""Plans stay the ones that scale: what shuffles, what reaches the scan, where Python runs."""

import re

from pyspark.sql import functions as F

from citescope.operators import history, panel, robots
from citescope.operators.scoring import page_scores, score_items, top_fixes
from citescope.operators.signals import page_signals
from citescope.plans.audit import audit
from citescope.registry import beds, scores, timeline

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_is_one_python_pass_without_shuffle(spark):
    text = plan(audit(spark.read.parquet(f"{SF}/pages.parquet")))
    assert text.count("ArrowEvalPython") == 1 and "Exchange" not in text


def test_unused_signals_are_pruned(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    text = plan(page_scores(page_signals(pages), ["page_id"]).select("page_id", "score"))
    assert "invisalign" not in text and "url" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_panel_reads_and_shuffles_little(spark):
    df = panel.panel_by_engine(beds.runs(spark, SF), beds.KEYS)
    text = plan(df)
    assert "value" not in re.search(r"ReadSchema: (.*)", text).group(1)
    assert text.count("Exchange hashpartitioning") == 2 and "partial_count" in text and "Python" not in text


def test_top_k_limits_before_the_shuffle(spark):
    for df in (
        top_fixes(beds.part_items(spark, SF).select("p_partkey", F.inline("items")), ["p_partkey"]),
        history.last_n_history(beds.history(spark, SF), ["site"], F.lit("1998-08-02").cast("timestamp")),
    ):
        text = plan(df)
        assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_history_filter_reaches_the_scan(spark):
    text = plan(history.last_n_history(beds.history(spark, SF), ["site"], F.lit("1998-08-02").cast("timestamp")))
    assert re.search(r"PushedFilters: \[.*o_orderdate", text)


def test_robots_summary_is_narrow(spark):
    df = spark.range(10).select(F.col("id").alias("host"), F.lit(200).alias("status"), F.lit("").alias("content_type"), F.lit("User-agent: *\nDisallow: /\n").alias("body"))
    assert "Exchange" not in plan(robots.robots_summary(df))


def test_no_forced_broadcasts_or_cross_joins(spark):
    from pathlib import Path

    source = "\n".join(p.read_text() for p in Path("citescope").rglob("*.py") if not {"registry", "llm"} & set(p.parts))
    for word in ("crossJoin", "broadcast(", "localCheckpoint", ".toPandas("):
        assert word not in source, word


def _largest_task(rows):
    return max(r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_targets_are_dealt_out(spark, folder):
    """One row group, which one task reads, must not become one task of calls."""
    spark.range(1, 20_001, 1, 1).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    assert _largest_task(timeline._targets(spark, folder)) < 6_000


def test_part_items_are_dealt_out(spark, folder):
    spark.range(1, 60_001, 1, 1).select(F.col("id").alias("p_partkey")).write.parquet(f"{folder}/part.parquet")
    assert _largest_task(scores._long_items(spark, folder)) < 9 * 25_000


def test_items_are_built_once(spark, folder):
    """A filter inferred from the generator would build them a second time, in the task that reads the row group."""
    spark.range(1, 60_001, 1, 1).select(F.col("id").alias("p_partkey")).write.parquet(f"{folder}/part.parquet")
    df = score_items(beds.part_signals(spark, folder), ["p_partkey"])
    assert not re.search(r"\bFilter \(", plan(df)) and _largest_task(df) < 9 * 25_000


def test_listings_are_dealt_out(spark, folder):
    listings = spark.range(1, 60_001, 1, 1).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit(1.5).alias("c_acctbal"))
    listings.write.parquet(f"{folder}/customer.parquet")
    assert _largest_task(beds.places(spark, folder)) < 25_000


def test_sites_are_dealt_out(spark, folder):
    spark.range(1, 60_001, 1, 1).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(f"{folder}/supplier.parquet")
    assert _largest_task(beds.sites(spark, folder)) < 25_000


def test_pages_of_a_batch_are_many_files(spark):
    """A file of a micro-batch is one task: 20,000 pages would be parsed by one core."""
    rows = spark.range(4_000).select("id", (F.col("id") % 4 + 1).cast("int").alias("_file"))
    _, folder = timeline._batches(spark, rows, timeline._PAGES_PER_FILE)
    assert len(spark.read.parquet(folder).inputFiles()) == 8
