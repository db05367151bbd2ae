"""Fixed-width pick files come back as written, and broken ones are named."""

from pyspark.sql import functions as F

from tracewell.sources import pickfile


def test_round_trip(spark, tmp_path):
    rows = [("a", 1, c, 10 * c) for c in range(1, 13)] + [("a", 2, 3, 0), ("b", 7, 12, 40), ("b", 7, 1, None)]
    picks = spark.createDataFrame(rows, "file string, rec int, channel int, pick int")
    pickfile.write(picks, f"file://{tmp_path}/out", 0.5, 12)
    found = pickfile.read(spark, f"file://{tmp_path}/out", 0.5)
    got = {(("a" if "file=a" in r.file else "b"), r.rec, r.channel): r["sample"] for r in found.collect()}
    assert len(got) == 36, sorted(got)
    assert {k: v for k, v in got.items() if v} == {("a", 1, c): 10 * c for c in range(1, 13)} | {("b", 1, 12): 40}
    assert pickfile.faults(found).count() == 0


def test_faults(spark, tmp_path):
    (tmp_path / "x.txt").write_text("* rec.no.=    1\nfb            1    2    5    6\nfb            4    5    7    8\n* rec.no.=    2\nfb            1    3    7    8\n")
    named = {r.fault for r in pickfile.faults(pickfile.read(spark, f"file://{tmp_path}", 1.0)).select("fault").collect()}
    assert named == {"blocks do not follow", "values do not match channels", "records differ in channels"}


def test_times(spark):
    t = spark.range(4).select(pickfile.milliseconds(F.when(F.col("id") > 0, F.col("id")), 0.5)).collect()
    assert [r[0] for r in t] == [-9999, -9999, 1, 2]
