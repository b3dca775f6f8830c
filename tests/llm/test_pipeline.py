"""The pipeline, stage by stage, against plain versions on the smallest table."""

import brute
import corpus_pipeline
from citescope.llm import leaks, toxic
from citescope.llm.common import stored

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    benchmark = [leaks.normal(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SMALL))
        kept[name] = docs
        if name == "toxicity":
            scores = toxic.score(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in scores.collect() if not r["predicted"]}
        elif name == "near_duplicates":
            groups = brute.similar_groups({r["doc_id"]: r["text"] for r in before.collect()})
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(groups.values()))
        elif name == "decontamination":
            leaking = {
                r["doc_id"] for r in before.collect()
                if any(b[:40] in leaks.normal(r["text"]) or b[-40:] in leaks.normal(r["text"]) for b in benchmark)
            }
            left = {r["doc_id"] for r in docs.collect()}
            assert left <= {r["doc_id"] for r in before.collect()} and not left & {
                r["doc_id"] for r in before.collect() if any(b in leaks.normal(r["text"]) for b in benchmark)
            }
            assert before.count() - docs.count() <= len(leaking)
        elif name == "mixture":
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
        if name != "token_output":
            assert docs.columns == columns
    rows = docs.orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in kept["mixture"].collect())
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    again = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
