"""SEG-Y by byte ranges: data source, header table, stitched output."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_support import segy_file

from tracewell.sources import segy, segy_output, segy_ranges


@pytest.fixture
def survey(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.sgy").write_bytes(segy_file(300, 50))
    (folder / "sub/b c.segy").write_bytes(segy_file(7, 11, ffid=9))
    (folder / "empty.sgy").write_bytes(segy_file(0, 11))
    (folder / "note.txt").write_text("none")
    return folder


def rows_of(df):
    return sorted((os.path.basename(segy_ranges.local(r.file)), r.trace_idx, r.ffid, r.chno, r.offset_m, r.dt_us, tuple(r.samples)) for r in df.collect())


def test_ranges_equal_the_whole_file(spark, survey):
    spark.dataSource.register(segy_ranges.SegyDataSource)
    want = []
    for name in ("a.sgy", "sub/b c.segy"):
        t = segy.traces((survey / name).read_bytes())
        want += [(os.path.basename(name), k, *(int(t[c][k]) for c in ("ffid", "chno", "offset_m", "dt_us")), tuple(t["samples"][k].tolist())) for k in range(len(t["ffid"]))]
    for split in (1000, 4096, segy_ranges.SPLIT):
        df = spark.read.format("segy").option("splitBytes", split).load(str(survey))
        assert rows_of(df) == sorted(want)
        assert rows_of(segy_ranges.scan(segy_ranges.listing(spark, str(survey)), split=split)) == sorted(want)
    parts = spark.read.format("segy").option("splitBytes", 4096).load(str(survey)).rdd.getNumPartitions()
    assert parts > 30
    few = spark.read.format("segy").option("firstTrace", 5).option("lastTrace", 8).load(str(survey))
    assert sorted(r.trace_idx for r in few.collect()) == [5, 5, 6, 6, 7, 8]


def test_header_scan_leaves_samples_unread(tmp_path, monkeypatch):
    path = tmp_path / "wide.sgy"
    path.write_bytes(segy_file(40, 3000))
    read, plain = [], segy_ranges.read_at
    monkeypatch.setattr(segy_ranges, "read_at", lambda f, at, n: read.append(n) or plain(f, at, n))
    n = sum(b.num_rows for b in segy_ranges.range_batches(str(path), 0, path.stat().st_size, headers_only=True))
    assert n == 40 and sum(read) < 0.05 * path.stat().st_size


def test_header_table_follows_the_files(spark, survey, tmp_path):
    cache = f"file://{tmp_path}/cache"
    one = segy_ranges.cached_headers(spark, str(survey), cache, split=4096)
    assert one.count() == 307 and set(one.columns) == {"file", "trace_idx", *segy.FIELDS, "dt_us"}
    files = lambda: {p for p in (tmp_path / "cache").rglob("*.parquet")}
    before = files()
    kept = (survey / "a.sgy").stat()
    (survey / "a.sgy").write_bytes(bytes(kept.st_size))  # no SEG-Y any more, but time and length as before: not opened again
    os.utime(survey / "a.sgy", ns=(kept.st_atime_ns, kept.st_mtime_ns))
    assert segy_ranges.cached_headers(spark, str(survey), cache).where("ffid = 7").count() == 300
    (survey / "a.sgy").write_bytes(segy_file(20, 50, ffid=5))
    again = segy_ranges.cached_headers(spark, str(survey), cache)
    assert again.where("ffid = 5").count() == 20 and again.where("ffid = 7").count() == 0 and again.count() == 27
    assert len(files()) > len(before)
    moved = segy_ranges.cached_headers(spark, str(survey), cache, fields={"cmp": (239, 4), "offset_m": (300, 4)})
    assert moved.where("cmp is null and offset_m = 0").count() == 27
    with pytest.raises(ValueError, match="ffid"):
        segy_ranges.usable({**segy.FIELDS, "ffid": (238, 4)})


def test_stitched_output(spark, survey, tmp_path):
    out, cache = tmp_path / "out", f"file://{tmp_path}/cache"
    (survey / "c.sgy").write_bytes(segy_file(6, 4, ffid=2))
    given = segy.read(spark, str(survey))
    scored = given.where("not (ffid = 2 and trace_idx in (1, 4))").select("file", "trace_idx", F.transform("samples", lambda v: v * 2).alias("samples"))
    scored.repartition(5).write.parquet(f"file://{tmp_path}/scored")
    scored = spark.read.parquet(f"file://{tmp_path}/scored")
    report = {os.path.basename(segy_ranges.local(r.file)): r for r in segy_output.stitch(spark, str(survey), scored, str(out), cache, notes=["scored"]).collect()}
    assert report["a.sgy"].written and report["b c.segy"].written and not report["c.sgy"].written
    assert (report["c.sgy"].n_traces, report["c.sgy"].n_filled) == (6, 4)
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == ["a.sgy", "sub/b c.segy"]
    for name in ("a.sgy", "sub/b c.segy"):
        old, new = (segy.traces((d / name).read_bytes()) for d in (survey, out))
        assert all((old[k] == new[k]).all() for k in old if k != "samples") and np.array_equal(new["samples"], 2 * old["samples"])
    assert (out / "a.sgy").read_bytes()[3120:3130] == b"C40 scored"
    lost = segy_output.missing_traces(segy_ranges.cached_headers(spark, str(survey), cache), scored).collect()
    assert sorted((r.ffid, r.trace_idx) for r in lost) == [(2, 1), (2, 4)]
    twice = scored.unionByName(scored.where("trace_idx = 0"))
    assert segy_output.fill_report(segy_ranges.cached_headers(spark, str(survey), cache), twice).where("n_repeated = 1").count() == 3
