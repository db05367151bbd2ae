import os
import re

import pytest

import __spark_entry__
from tracewell.operators import gathers, statics, trend
from tracewell.plans import views

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def reread(df):
    """Frames of the plan that end at the last row but begin at or behind the row."""
    return re.findall(r"(?<!unboundedpreceding\$\(\), )unboundedfollowing", plan(df))


def test_fills_read_each_frame_once(spark):
    """A frame that ends behind the row is read anew for every row."""
    rows = spark.createDataFrame([(1, i, float(i) if i % 3 == 0 else None) for i in range(10)], "k long, trace_idx long, v double")
    filled = gathers.nearest_fill(rows, ["k"], "trace_idx", "v", "out")
    assert [r.out for r in filled.orderBy("trace_idx").collect()] == [0, 0, 3, 3, 3, 6, 6, 6, 9, 9]
    gaps = rows.withColumnRenamed("trace_idx", "rank").selectExpr("*", "rank as trace_idx")
    gaps = gaps.withColumn("out", trend.filled_gaps(gaps, ["k"], "v"))
    assert [r.out for r in gaps.orderBy("rank").collect()] == list(range(10))
    for df in (filled, gaps):
        assert not reread(df)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
def test_trace_tasks_hold_a_share_that_does_not_grow(spark):
    assert gathers.spread(spark, 36_000_000, 150_000) == 240
    assert views.trace_hdr(spark, SMALL).rdd.getNumPartitions() == gathers.spread(spark, 6000, 150_000)
    for name in ("trend_assembly", "nearest_fill", "gap_interpolation"):
        assert not reread(__spark_entry__.queries()[name](spark, SMALL))


def test_bands_are_hidden_in_the_task_that_holds_the_tile(spark):
    rows = spark.createDataFrame([(1, i, 5, [float(i), 1.0]) for i in range(5)], "k long, rank long, n long, samples array<double>")
    out = statics.striped(rows, ["k"], 2, lambda x: x + x.sum(axis=0))
    assert "generate" not in plan(out)
    assert {r["rank"]: r.samples for r in out.collect()} == {0: [9.0, 3.0], 1: [9.0, 3.0], 2: [5.0, 3.0], 3: [5.0, 3.0], 4: [6.0, 4.0]}


def test_view_rows_are_joined_once(spark):
    rows = [(k, i, n, 10 * i + 1, float(i * i)) for k, n in ((1, 1), (2, 2), (3, 7), (4, 30)) for i in range(n)]
    given = spark.createDataFrame(rows, "k long, rank long, n long, fb long, offset_m double")
    from tracewell.operators import picks

    for flip, factor in ((True, 1.1), (False, 1.1), (True, 0.7), (False, 0.7)):
        out = picks.projected(given, ["k"], flip, factor, 1.0, 0, 512)
        assert plan(out).count("join inner") == 1 and "generate" not in plan(out)
        got = {(r.k, r.row): (r.fb_view, round(r.offset_view, 6)) for r in out.collect()}
        assert len(got) == len(rows)
        for k, i, n, *_ in rows:
            end = n - 1
            at = end * 0.5 + (i - end * 0.5) / factor
            held = min(max(at, 0.0), float(end))
            turn = lambda j: end - min(max(int(j), 0), end) if flip else min(max(int(j), 0), end)  # noqa: B023, E731
            near, low, high = turn((at + 0.5) // 1), turn(held // 1), turn(held // 1 + 1)
            share = held - held // 1
            assert got[k, i] == (10 * near + 1, round((1 - share) * low * low + share * high * high, 6))


def test_sampled_lines_are_tried_in_batches(spark):
    """Trials run over the arrays of a batch of sections, not as expressions read anew for every row of a section."""
    rows = [(k, i, 8, 100.0 * i, None if (k, i) == (2, 3) else 0.1 * i + (0.7 if i == 5 else 0.0), 1, 1 + i % 3) for k in range(1, 4) for i in range(8)]
    given = spark.createDataFrame(rows, "k long, rank long, n long, x double, y double, valid int, w int")
    out = statics.consensus_trend(given, ["k"], 8, 8, "s", trials=16)
    assert plan(out).count("arrowevalpython") == 1 and "array_max" not in plan(out)
    got = {(r.k, r.rank): r for r in out.collect()}
    assert len(got) == len(rows)
    for k, i, *_ in rows:
        r = got[k, i]
        assert r.covered == (k != 2 and i in (1, 2, 3, 4, 6)), (k, i)  # tapers are 0 at the ends; a null leaves no line
        if r.covered:
            assert abs(r.trend_t - 0.1 * i) < 1e-9 and abs(r.trend_s - 0.001) < 1e-12
    assert got[2, 3].trend_t is None and got[2, 3].trend_s == 0
