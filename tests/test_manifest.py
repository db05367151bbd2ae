"""Manifests, lineage, contracts, SEG-Y written like its input."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.sources import manifest, segy


def sample_file(n=3, ns=4, kind=5):
    head = bytearray(b" " * segy.TEXT + b"\0" * segy.BINARY)
    for at, v in ((16, 2000), (20, ns), (24, kind)):
        head[segy.TEXT + at : segy.TEXT + at + 2] = np.array([v], ">u2").tobytes()
    body = b""
    for i in range(n):
        trace = bytearray(segy.TRACE)
        trace[8:12] = np.array([7], ">i4").tobytes()
        trace[12:16] = np.array([i + 1], ">i4").tobytes()
        body += bytes(trace) + np.arange(i, i + ns, dtype=">f4").tobytes()
    return bytes(head) + body


def test_written_like_input(spark, tmp_path):
    (tmp_path / "a.sgy").write_bytes(sample_file())
    read = segy.read(spark, f"file://{tmp_path}")
    new = read.where("trace_idx <> 1").select("file", "trace_idx", F.transform("samples", lambda v: v * 2).alias("samples"))
    rows = segy.like_input(spark, f"file://{tmp_path}", new, notes=["scored"]).collect()
    assert len(rows) == 1
    back = segy.traces(bytes(rows[0].content))
    assert back["chno"].tolist() == [1, 3] and back["ffid"].tolist() == [7, 7]
    assert back["samples"].tolist() == [[0, 2, 4, 6], [4, 6, 8, 10]]
    assert bytes(rows[0].content)[3120:3130] == b"C40 scored"


def test_resampled_window():
    out = segy.traces(segy.file_bytes(sample_file(), np.ones((3, 8)), dt_us=1000))
    assert out["samples"].shape == (3, 8) and set(out["dt_us"]) == {1000}


def test_data_id_depends_on_rows_not_order(spark):
    rows = [("g", "a", 1), ("g", "b", 2), ("h", "a", 1)]
    one = manifest.data_id(spark.createDataFrame(rows, "k string, path string, size int"), ["k"])
    two = manifest.data_id(spark.createDataFrame(rows[::-1], "k string, path string, size int"), ["k"])
    ids = {r.k: r.data_id for r in one.collect()}
    assert ids == {r.k: r.data_id for r in two.collect()}
    assert ids["g"] != ids["h"] and len(ids["g"]) == 12


def test_lineage_and_contract(spark):
    rows = manifest.with_lineage(spark.range(1), 2, "m", {"b": 1, "a": 2}, "abc")
    again = manifest.with_lineage(spark.range(1), 2, "m", {"a": 2, "b": 1}, "abc")
    assert rows.first() == again.first()
    contract = StructType.fromDDL("id bigint, pick int, iter_id bigint")
    assert manifest.schema_faults(rows, contract) == ["pick is missing", "iter_id is int, not bigint"]


def test_pairs(spark):
    w = spark.createDataFrame([("/d/a.win512.sgy",), ("/d/b.win512.sgy",)], "path string")
    p = spark.createDataFrame([("/d/a.phase.npz",), ("/d/a.other",)], "path string")
    assert [r.path for r in manifest.paired(w, p).collect()] == ["/d/a.win512.sgy"]
