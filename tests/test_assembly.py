"""The assembled trend against plain loops."""

import random

import pytest

from tracewell.operators import assembly
from tracewell.operators.assembly import AssemblyKnobs

KNOBS = AssemblyKnobs(n_samples=200, diff_th=20.0, inv_drop=4.0, inv_steps=2, discard_radius=1)


def by_hand(rows):
    """rows of one gather: trace_idx, signed, local, whole."""
    inside = lambda v: None if v is None or v != v else min(max(v, 1.0), 199.0)
    local = [inside(r[2]) if r[2] is not None and r[2] > 0 else None for r in rows]
    known = [inside(r[3]) for r in rows]
    ok = [i for i, g in enumerate(known) if g is not None]
    whole = [known[min(ok, key=lambda j: (abs(j - i), j))] if ok else None for i in range(len(rows))]
    sides = [sorted((i for i, r in enumerate(rows) if r[1] is not None and (r[1] < 0) == left and r[1] != 0), key=lambda i: (abs(rows[i][1]), i)) for left in (True, False)]
    seeds = set()
    for side in sides:
        have = [i for i in side if local[i] is not None]
        falls = [local[b] < local[a] - 4 for a, b in zip(have, have[1:])]
        if any(x and y for x, y in zip(falls, falls[1:])):
            seeds |= {i for i in have if whole[i] is not None and abs(whole[i] - local[i]) >= 20}
    gone = {i for i in range(len(rows)) if any(abs(i - s) <= 1 for s in seeds)}
    kept = [None if i in gone else local[i] for i in range(len(rows))]
    out = {}
    for i, r in enumerate(rows):
        if kept[i] is not None or r[1] == 0:
            out[i] = ("local", local[i])
            continue
        side = next((s for s in sides if i in s), [])
        at = side.index(i) if side else 0
        b = next((j for j in range(at - 1, -1, -1) if kept[side[j]] is not None), None) if side else None
        a = next((j for j in range(at + 1, len(side)) if kept[side[j]] is not None), None) if side else None
        if b is not None and a is not None and kept[side[b]] <= kept[side[a]]:
            w = (at - b) / (a - b)
            out[i] = ("between", (1 - w) * kept[side[b]] + w * kept[side[a]])
        else:
            out[i] = ("global", whole[i])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_loops(spark, seed):
    rng = random.Random(seed)
    given = {}
    for g in range(12):
        n = rng.choice([1, 2, 7, 30])
        split = rng.randrange(n)
        rows = []
        for i in range(n):
            x = rng.choice([0.0, 5.0, 10.0 * abs(i - split), float("nan")]) if g % 3 == 0 else 10.0 * abs(i - split)
            signed = None if x != x else (-x if i < split else x)
            local = rng.choice([None, float("nan"), 0.0, 40 + abs(i - split) * 2.0, 40 + abs(i - split) * 2.0, 150 - 6.0 * abs(i - split), 500.0])
            whole = rng.choice([None, float("nan"), 60 + 1.0 * abs(i - split), 60 + 1.0 * abs(i - split)]) if g != 4 else None
            rows.append((i, signed, local, whole))
        given[g] = rows
    data = spark.createDataFrame([(g, *r) for g, rows in given.items() for r in rows], "g int, trace_idx long, signed double, local double, whole double")
    found = {(r.g, r.trace_idx): (r.source, r.trend_i) for r in assembly.assembled(data, ["g"], "local", "whole", KNOBS).collect()}
    for g, rows in given.items():
        for i, (source, value) in by_hand(rows).items():
            assert found[g, i][0] == source
            assert found[g, i][1] == (None if value is None else pytest.approx(value))


def test_empty(spark):
    rows = spark.createDataFrame([], "g int, trace_idx long, signed double, local double, whole double")
    assert assembly.assembled(rows, ["g"], "local", "whole", KNOBS).count() == 0
