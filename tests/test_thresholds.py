import math
from fractions import Fraction

from pyspark.sql import functions as F

from tracewell.operators import gates

SCHEMA = "file_id long, valid boolean, s double, t double"


def held(n, lo, hi):
    """n scores of which the 5 % point lies between lo and hi."""
    below = math.floor((n - 1) * 0.05) + 1
    return [lo / 100] * below + [hi / 100] * (n - below)


def wanted(n, lo, hi):
    p = (n - 1) * 0.05
    w = p - math.floor(p)
    return float(Fraction(lo / 100) * Fraction(1 - w) + Fraction(hi / 100 * w))


def test_thresholds_are_rounded_once_as_sql_does(spark):
    cases = [(n, lo, lo + d) for n in (21, 23, 26, 30, 37, 58, 62, 95) for lo in (0, 3, 7, 41, 88) for d in (0, 1, 2, 5, 11)]
    rows = [(k, True, v, None) for k, c in enumerate(cases) for v in held(*c)]
    out = gates.thresholds(spark.createDataFrame(rows, SCHEMA), ["file_id"], {"a": "s", "b": "t"}, 0.05).collect()
    assert {r.file_id: r.a for r in out} == {k: held(n, lo, hi)[0] if lo == hi or (n - 1) % 20 == 0 else wanted(n, lo, hi) for k, (n, lo, hi) in enumerate(cases)}
    assert all(r.b is None for r in out)


def test_a_row_that_does_not_count_may_lie_on_the_threshold(spark):
    n, lo, on, hi = 26, 5, 6, 9
    rows = [(7, True, v, v) for v in held(n, lo, hi)] + [(7, False, on / 100, on / 100)]
    table = spark.createDataFrame(rows, SCHEMA)
    th = gates.thresholds(table.where("valid"), ["file_id"], {"a": "s"}, 0.05)
    near = table.join(th, "file_id").where("not valid").select((F.col("s") >= F.col("a")).alias("kept")).first()
    assert near.kept == (on / 100 >= wanted(n, lo, hi))
    plain = table.where("valid").agg(F.percentile("s", 0.05).alias("a")).first().a
    assert near.kept != (on / 100 >= plain)
