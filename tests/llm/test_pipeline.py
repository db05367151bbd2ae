"""The corpus pipeline, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents").withColumn("score", F.lit(1)).withColumn("n_bytes", F.lit(2))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns and docs.count() <= before
            assert docs.where("n_bytes <> 2 or score <> 1").count() == 0
            assert docs.count() > 0.5 * before
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)


def test_empty(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_leaves_its_result_only(spark, tmp_path):
    from pathlib import Path

    from tracewell.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://")) / "tracewell"
    before = set(folder.iterdir()) if folder.exists() else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [p.name[:7] for p in set(folder.iterdir()) - before] == ["stage-4"]


def test_odd_rows_come_through(spark):
    """Null, shared and large ids, nullable and clashing columns, in all stages but the last."""
    text = lambda a: " ".join(f"{a}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))
    big = (1 << 53) + 1
    rows = [(None, text("a"), "h", 1, big, None), (big, text("b"), None, 1, None, 7), (big, text("c"), "h", 1, big, 8), (None, text("d"), "h", 1, 5, big)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _d long, kept long").withColumn("n_chars", F.length("text").cast("long"))
    labels_from = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, labels_from)
        assert got.columns == docs.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    assert stage(spark, docs.union(docs), labels_from).count() == 8
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, labels_from).collect()} == {None, big}
