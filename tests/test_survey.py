"""Azimuth bins against plain loops, day arrays read back."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators.azimuth import AzimuthKnobs, azimuth_cuts, azimuth_labels
from tracewell.plans import survey_queries
from tracewell.sources import dayarrays

SF = "/root/testdata/sf0.001"


def plain_cuts(angles, k):
    """origin, cuts, whether by quantiles, bin of every angle."""
    a = [math.radians(v) % (2 * math.pi) for v in angles]
    s = sorted(set(a))
    gaps = [(s[i + 1] if i + 1 < len(s) else s[0] + 2 * math.pi) - s[i] for i in range(len(s))]
    origin = s[(gaps.index(max(gaps)) + 1) % len(s)]
    turned = [(v - origin) % (2 * math.pi) for v in a]
    at = [math.floor(v / (2 * math.pi) * k.bins) % k.bins for v in turned]
    h = [at.count(b) for b in range(k.bins)]
    n, w = k.bins, k.width
    h = [sum(h[(i - d) % n] / w for d in range(w // 2 - w + 1, w // 2 + 1)) for i in range(n)]
    h = [round(v, 9) for v in h]

    def shoulder(i, way):
        j = i + way
        while h[(j + way) % n] <= h[j % n] and (j + way) % n != i:
            j += way
        return h[j % n]

    low = [i for i in range(n) if h[i - 1] > h[i] < h[(i + 1) % n] and min(shoulder(i, -1), shoulder(i, 1)) - h[i] >= max(k.prominence * len(a), 1)]
    cuts = []
    for i in sorted(low, key=lambda i: (h[i], i)):
        if all(min((i - c) % n, (c - i) % n) > k.apart for c in cuts):
            cuts.append(i)
    even = not cuts
    if even:
        parts = max(1, min(k.most_bins, len(a) // k.rows_a_bin))
        if parts > 1:
            edges = np.quantile(turned, [j / (parts + 1) for j in range(1, parts + 1)])
            cuts = [int(e / (2 * math.pi) * n) % n for e in edges]
    cuts.sort()
    return origin, cuts, even, [sum(c <= b for c in cuts) % len(cuts) if cuts else 0 for b in at]


CASES = {
    "lobes": lambda r: [r.gauss(c, 12) for c in (20, 130, 260) for _ in range(400)],
    "even": lambda r: [r.uniform(0, 360) for _ in range(900)],
    "notched": lambda r: [10 * b + r.uniform(0, 10) for b in range(36) for _ in range(50 * (1 + min(b % 12, 12 - b % 12)))],
    "few": lambda r: [10.0, 10.0, 200.0],
    "one": lambda r: [77.0] * 5,
    "turned": lambda r: [r.choice([-1, 1]) * 360 + r.gauss(c, 9) for c in (0, 90) for _ in range(300)],
}


@pytest.mark.parametrize("bins, width", [(36, 3), (72, 4)])
def test_azimuth_equals_loops(spark, bins, width):
    knobs = AzimuthKnobs(bins=bins, width=width, prominence=0.001, apart=3, rows_a_bin=100)
    given = {name: made(random.Random(3)) for name, made in CASES.items()}
    rows = [(name, k, float(v)) for name, angles in given.items() for k, v in enumerate(angles)] + [("few", 9, None)]
    df = spark.createDataFrame(rows, "g string, i int, az double").repartition(3)
    cuts = {r.g: r for r in azimuth_cuts(df, ["g"], F.col("az"), knobs).collect()}
    labels = {(r.g, r.i): r.azimuth_bin for r in azimuth_labels(df, ["g"], F.col("az"), knobs).collect()}
    split = 0
    for name, angles in given.items():
        origin, want, even, at = plain_cuts(angles, knobs)
        assert (cuts[name].rows, cuts[name].fallback, list(cuts[name].cuts)) == (len(angles), even, want), name
        assert abs(cuts[name].origin - origin) < 1e-12
        assert [labels[name, k] for k in range(len(angles))] == at, name
        split += not even
    assert split and labels["few", 9] is None


def test_azimuth_query_over_all_traces(spark):
    rows = survey_queries._seen(spark, SF).collect()
    got = {(r.file_id, r.trace_idx): r.azimuth_bin for r in survey_queries.azimuth_bins(spark, SF).collect()}
    lines: dict = {}
    for r in rows:
        lines.setdefault(r.shot_line, []).append(r)
    for rs in lines.values():
        *_, at = plain_cuts([r.azimuth for r in rs], survey_queries.KNOBS)
        assert [got[r.file_id, r.trace_idx] for r in rs] == at
    assert len(got) == len(rows)


def test_empty_azimuths(spark):
    df = spark.createDataFrame([], "g string, az double")
    assert azimuth_labels(df, ["g"], F.col("az")).count() == 0


def test_day_arrays(spark, tmp_path):
    n = 86400 + 2 * 30
    a = np.arange(2 * n, dtype=np.float32).reshape(2, n)
    np.save(tmp_path / "JST_20200211_1Hz_pad30s.npy", a)
    np.save(tmp_path / "JST_20200213_1Hz_pad30s.npy", a)
    days = dayarrays.days(spark, "20200210", "20200212")
    assert [r.day for r in days.orderBy("day").collect()] == [datetime.date(2020, 2, d) for d in (10, 11, 12)]
    got = dayarrays.read_days(spark, f"file://{tmp_path}", days, 1, 30, 50_000, [1]).orderBy("start").collect()
    assert [(r.day.day, r.channel, r.start, len(r.samples)) for r in got] == [(11, 1, 0, 50_000), (11, 1, 50_000, n - 50_000)]
    assert np.array_equal(np.concatenate([r.samples for r in got]), a[1])
    with pytest.raises(Exception, match="no channel 2"):
        dayarrays.read_days(spark, f"file://{tmp_path}", days, 1, 30, 50_000, [2]).collect()
    with pytest.raises(Exception, match="not \\(channels"):
        dayarrays.read_days(spark, f"file://{tmp_path}", days, 1, 30, 50_000, template="JST_{YYYYMMDD}_{fs}Hz_pad30s.npy").count() + dayarrays.read_days(spark, f"file://{tmp_path}", days, 2, 30, 50_000, template="JST_{YYYYMMDD}_1Hz_pad{pad}s.npy").count()
    with pytest.raises(Exception, match="lies before"):
        dayarrays.days(spark, "20200212", "20200210").collect()
