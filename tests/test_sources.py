import struct

import numpy as np
from pyspark.sql import functions as F

from tracewell.sources import listfiles, segy


def small_file(n, ns, kind=5):
    out = bytearray(3600)
    struct.pack_into(">H", out, 3216, 2000)
    struct.pack_into(">H", out, 3220, ns)
    struct.pack_into(">H", out, 3224, kind)
    for i in range(n):
        head = bytearray(240)
        struct.pack_into(">i", head, 8, 1)
        struct.pack_into(">i", head, 12, i + 1)
        struct.pack_into(">i", head, 36, 10 * (i + 1))
        out += head + (np.arange(ns) + 100 * i).astype(">f4").tobytes()
    return bytes(out)


def test_segy(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.sgy").write_bytes(small_file(5, 16))
    (tmp_path / "b.segy").write_bytes(small_file(2000, 4))
    (tmp_path / "c.txt").write_text("no traces")
    rows = segy.read(spark, str(tmp_path))
    assert rows.count() == 2005
    r = rows.where(F.endswith("file", F.lit("a.sgy")) & (F.col("trace_idx") == 3)).first()
    assert (r.ffid, r.chno, r.offset_m, r.dt_us) == (1, 4, 40, 2000) and list(r.samples) == [300.0 + t for t in range(16)]
    assert segy.read(spark, str(tmp_path), headers_only=True).where("samples is not null").count() == 0


def test_ibm_floats():
    raw = np.array([0x42640000, 0xC276A000, 0x00000000], np.uint32)
    assert segy.ibm_to_float(raw).tolist() == [100.0, -118.625, 0.0]


def test_list_files(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("/a/b.sgy",), ('/c d.sgy\t{"k": "v"}',), ('/e.sgy {"x": "1", "y": "2"}',)], "value string")
    found = [(r.path, r.meta) for r in listfiles.manifest(lines).collect()]
    assert found == [("/a/b.sgy", None), ("/c d.sgy", {"k": "v"}), ("/e.sgy", {"x": "1", "y": "2"})]
