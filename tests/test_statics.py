"""Statics against known shifts and dense solvers."""

import numpy as np

from tracewell.operators import statics


def wavelet(at):
    t = np.arange(120)
    a = ((t - at) / 4.0) ** 2
    return (1 - 2 * a) * np.exp(-a)


def test_known_shifts_are_found(spark):
    shifts = [0, 1, -2, 2, 0, -1, 1, 0, 2, -2, 0, 1]
    rows = [(1, i, [float(v) for v in wavelet(60 + s)] if i != 5 else [0.0] * 120) for i, s in enumerate(shifts)]
    frame = spark.createDataFrame(rows, "g int, i long, samples array<double>")
    found = {r.i: r for r in statics.refine(frame, ["g"], "i", 8, 5, 2, 0.3, lam=0.01).collect()}
    assert not found[5].valid and found[5].delta_pick == 0.0
    errors = [found[i].delta_pick - s for i, s in enumerate(shifts) if i != 5]
    assert np.ptp(errors) < 1.0


def test_smoothing_solves_its_equations():
    rng = np.random.default_rng(1)
    d, w = rng.normal(size=9), rng.random(9)
    first = np.diff(np.eye(9), axis=0)
    assert np.allclose(statics.smoothed(d, w, 5.0), np.linalg.solve(np.diag(w) + 5 * first.T @ first, w * d))
    assert (statics.smoothed(d, np.zeros(9), 5.0) == 0).all()


def test_lag_ties_take_the_small_one():
    flat = np.zeros((1, 12))
    lag, c = statics.lags(flat, flat, 3, 0.0, False)
    assert lag[0] == 0 and c[0] == 0


def test_trend_of_a_line_ignores_an_outlier(spark):
    rows = [(1, i, 20, 100.0 * i, 0.1 + 0.0005 * 100 * i + (5 if i == 7 else 0), 1, 1.0) for i in range(20)]
    frame = spark.createDataFrame(rows, "g int, rank long, n long, x double, y double, valid int, w double")
    out = statics.robust_trend(frame, ["g"], 20, 20, rounds=30).where("covered").collect()
    assert len(out) == 18
    assert all(abs(r.trend_t - (0.1 + 0.05 * r.rank)) < 0.05 for r in out)


def test_consensus_trend_follows_the_inliers(spark):
    """A third of the picks lie on a wrong line; no-weight sections and equal offsets have no line."""
    rows = [(0, k, 24, 10.0 * k, 0.1 + 10.0 * k / 2000 + (0.5 + 0.02 * k if k % 3 == 0 else 0), 1, 1.0) for k in range(24)]
    rows += [(1, k, 6, 10.0 * k, 0.1, 0, 1.0) for k in range(6)]  # none valid
    rows += [(2, k, 6, 50.0, 0.1, 1, 1.0) for k in range(6)]  # one offset
    rows += [(3, k, 3, 10.0 * k, 0.1, 1, 1.0) for k in range(3)]  # too short
    frame = spark.createDataFrame(rows, "g int, rank long, n long, x double, y double, valid int, w double")
    out = statics.consensus_trend(frame, ["g"], 24, 24, "s", tau=0.0).collect()
    assert {r.g for r in out} == {0}
    covered = [r for r in out if r.covered]
    assert [r["rank"] for r in sorted(covered)] == [k for k in range(1, 23) if k % 3]
    for r in covered:
        assert abs(r.trend_t - (0.1 + 10.0 * r["rank"] / 2000)) < 1e-9 and abs(r.trend_s - 1 / 2000) < 1e-9
    assert statics.consensus_trend(frame.limit(0), ["g"], 24, 24, "s").count() == 0
