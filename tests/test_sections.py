"""Phase files, overrides, global trends by side and section padding, by hand."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewell.operators import draws, phases, sections, trend
from tracewell.sources import phasepicks


def test_phase_files(spark, tmp_path):
    good = {"p_indptr": [0, 2, 2, 3], "p_data": [10, 20, 5], "s_indptr": [0, 0, 1, 1], "s_data": [30]}
    for name, change in {"a": {}, "b": {"p_indptr": [0, 2, 1, 3]}, "c": {"s_indptr": [0, 1]}, "d": {"p_data": [1.5]}, "e": {"p_indptr": [1, 2, 2, 3]}, "f": {"s_data": [30, 31]}}.items():
        np.savez(f"{tmp_path}/{name}.npz", **{k: np.array(v) for k, v in (good | change).items()})
    picks, rejected = phasepicks.validated(phasepicks.read(spark, str(tmp_path)))
    assert {(r.trace_idx, r.phase, r.pick) for r in picks.collect()} == {(0, "P", 10), (0, "P", 20), (2, "P", 5), (1, "S", 30)}
    assert {r.path[-5]: list(r.faults) for r in rejected.collect()} == {"b": ["p falling"], "c": ["s traces"], "d": ["array p_data"], "e": ["p start"], "f": ["s length"]}
    rows = spark.createDataFrame([(7, *good.values())], "id long, " + ", ".join(f"{n} array<long>" for n in phasepicks.NAMES))
    (row,) = phasepicks.file_bytes(rows, "id").collect()
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "x.npz").write_bytes(row.content)
    again = phasepicks.read(spark, f"{tmp_path}/out").first()
    assert [list(again[n]) for n in phasepicks.NAMES] == list(good.values())


def test_first_breaks_must_pair(spark):
    traces = spark.range(4).withColumnRenamed("id", "trace_idx")
    breaks = traces.withColumn("fb", F.col("trace_idx") + 1)
    assert phases.with_first_breaks(traces, breaks, ["trace_idx"]).count() == 4
    with pytest.raises(PySparkException, match="differ in length"):
        phases.with_first_breaks(traces, breaks.where("trace_idx < 3"), ["trace_idx"]).collect()


def test_overrides(spark):
    texts = [None, '{"primary_keys": ["ffid"]}', '{"primary_keys": ["sx"]}', '{"primary_ranges": {"chno": [[5, 2]]}}', '{"primary_ranges": {"chno": [[1, 2], [4, 9]]}}', "{no", '{"primary_keys": []}']
    read, rejected = draws.overrides(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, text string"), "text")
    assert {r.i for r in read.collect()} == {0, 1, 4}
    assert {r.i: r.reason for r in rejected.collect()} == {2: "primary_keys", 3: "range", 5: "json", 6: "primary_keys"}


def test_global_trend_by_side(spark):
    lines = {-1: (500.0, 0.002, 0.1, 0.001), 1: (400.0, 0.0016, 0.2, 0.0008)}
    rows = []
    for side, (xb, a1, b1, a2) in lines.items():
        for x in range(10, 1000, 10):
            rows.append((1, float(x), float(side * x), a1 * min(x, xb) + b1 + a2 * max(x - xb, 0)))
    rows += [(2, float(x), -float(x), 0.001 * x) for x in (100, 200)]
    data = spark.createDataFrame(rows, "file_id long, x double, proxy double, y double")
    out = trend.global_trend(data, ["file_id"], "x", "proxy", F.col("y"), F.lit(1.0), 300.0, 8000.0, 1e-6, 10, bins=99)
    found = out.collect()
    assert len(found) == len(rows) and all(abs(r.trend - r.y) < 0.02 for r in found if r.file_id == 1)
    assert all(abs(r.trend - r.y) < 2e-3 for r in found if r.file_id == 2)  # too few for a side or a break: one line


def test_stretch_of_a_slow_wave(spark):
    t = np.arange(200)
    rows = spark.createDataFrame([(np.sin(t / 15).tolist(),)], "a array<double>")
    y = np.array(rows.select(sections.time_stretched(F.col("a"), 1.25)).first()[0])
    assert len(y) == 250 and np.abs(y - np.sin(np.arange(250) / 1.25 / 15))[20:-20].max() < 2e-3


def test_gather_of_another_shape_fails(spark):
    rows = spark.createDataFrame([(1, 0, 0, [1.0, 2.0])], "ffid long, trace_idx long, rank long, samples array<double>")
    with pytest.raises(PySparkException, match="was scored as"):
        sections.score_gathers(rows, ["ffid"], "rank", "samples", lambda x: x[:, :1]).collect()
