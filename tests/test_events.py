"""Event operators against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import events
from tracewell.plans import registry

SF = "/root/testdata/sf0.001"


def starts(r, on, off, min_on, refractory):
    out, run, active, last = [], 0, False, -(10**6)
    for t, v in enumerate(r):
        run = run + 1 if v > on else 0
        if not active and run >= min_on and t - run + 1 - last >= refractory:
            active, last = True, t - run + 1
            out.append(last)
        elif v <= off:
            active = False
    return out


def test_clusters_against_loops(spark):
    rng = np.random.default_rng(3)
    traces = [(g, [float(v) for v in rng.integers(0, 4, 30)]) for g in (1, 1, 1, 2)]
    frame = spark.createDataFrame(traces, "g int, ratio array<double>")
    found = {r.g: r for r in events.pick_clusters(frame, ["g"], 1.5, 0.5, 2, 4, 5, 3).collect()}
    for g in (1, 2):
        counts = np.zeros(30, int)
        for k, r in traces:
            if k == g:
                for t in starts(r, 1.5, 0.5, 2, 4):
                    counts[t] += 1
        sums = []
        for t in range(30):
            b = min(max(t - 2, 0) + 5, 30)
            sums.append(counts[b - 5 : b].sum())
        assert list(counts) == found[g].counts
        assert sums == found[g].clusters
        assert found[g].is_event == (max(sums) >= 3)


def test_no_trigger_is_no_event(spark):
    frame = spark.createDataFrame([(1, [0.0] * 6)], "g int, ratio array<double>")
    row = events.pick_clusters(frame, ["g"], 1.5, 0.5, 2, 4, 5, 3).first()
    assert row.clusters == [0] * 6 and row.is_event is False


def test_equal_peaks_keep_their_distance(spark):
    curve = [0.0, 5.0, 1.0, 5.0, 1.0, 5.0, 0.0, 0.0, 0.0, 3.0, 0.0]
    rows = spark.createDataFrame([(1, t, s) for t, s in enumerate(curve)], "g int, t int, s double")
    assert sorted(r.t for r in events.peaks(rows, ["g"], 1.0, 2, 1).collect()) == [1, 5, 9]


def test_decision_agrees_with_its_parts(spark):
    got = {r.ffid: r.decision for r in registry.queries()["noise_decision"](spark, SF).collect()}
    b = {r.ffid: r.is_event for r in registry.queries()["pick_cluster_event"](spark, SF).collect()}
    a = {r.ffid for r in registry.queries()["majority_event"](spark, SF).select("ffid").distinct().collect()}
    assert got == {f: "reject_B" if b[f] else "reject_A" if f in a else "noise" for f in b}


def test_parabola(spark):
    r = spark.createDataFrame([([0.8, 1.0, 0.5],), ([1.0, 0.0, 0.0],)], "p array<double>").select(events.parabolic_argmax(F.col("p"))).collect()
    assert [round(x[0], 3) for x in r] == [0.786, 0.0]
