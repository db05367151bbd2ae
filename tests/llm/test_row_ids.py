"""Null and shared doc_ids cost no row in the first stage."""

import corpus_pipeline


def test_quality_stage_keeps_odd_ids(spark):
    text = lambda a: " ".join(f"{a}{k}" for k in range(80))
    rows = [(None, text("a"), "h", 0, 1.5), (None, text("b"), "h", 0, 2.5), (4, text("c"), None, 0, 3.5), (4, text("d"), "h", 0, 4.5), (4, "short", "h", 0, 5.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, score double")
    got = corpus_pipeline.quality(spark, docs, "")
    assert got.columns == docs.columns
    want = {(i, t, s, len(t), x) for i, t, s, _, x in rows[:4]}
    assert set(map(tuple, got.collect())) == want and got.count() == 4
