"""The pipeline's stages, each held against a plain version on its own input."""

from collections import Counter

import corpus_pipeline
from test_op4_dartmin import brute_classes
from test_op7_rules import brute
from test_op9_packing import check_packing

from ridgeline.llm import mixing, rules, toxicity


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = docs.columns
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf).cache()
        kept[name] = (before, after)
        if name != "packing":
            assert after.columns == names
            rows, source = Counter(map(tuple, after.collect())), Counter(map(tuple, before.collect()))
            assert not rows - source and sum(rows.values()) > 0.5 * sum(source.values())
        before = after

    before, after = kept["toxicity"]
    bad = {r.doc_id for r in toxicity.classify(before, labels).collect() if r.predicted}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad

    before, after = kept["quality"]
    failed = {r.doc_id for r in before.collect() if (b := brute(r.text))[0] < 50 or 100 * b[4] > 50 * b[0]}
    learned = {r.doc_id for r in rules.classify(before, labels).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == learned and not learned & failed

    before, after = kept["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {c for _, c in brute_classes([(r.doc_id, r.text) for r in before.collect()])}

    before, after = kept["mixing"]
    rates = mixing.sample_rates(before, corpus_pipeline.LANG_WEIGHTS, budget=corpus_pipeline.BUDGET, max_rate=1.0).collect()
    assert all(r.rate <= 1 for r in rates)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rates if r.copies}

    before, after = kept["packing"]
    check_packing(after.collect(), [(r.doc_id, r.text) for r in before.collect()])


def test_run_and_registration(spark):
    import __spark_entry__

    q = __spark_entry__.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in q) >= 10 and "pipeline" in q
    out = q["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
