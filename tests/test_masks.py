import hashlib
import math

import pytest

from tracewell.operators import labels


def plain(n, ratio, width, seed):
    target = round(ratio * n)
    if target >= n or (width >= n and target > 0):
        return [True] * n
    by = sorted(range(n), key=lambda r: (hashlib.md5(f"{seed}:{r}".encode()).hexdigest(), r))
    chosen = by[: max(math.ceil(target / width), 1)] if target > 0 else []
    starts = [max(min(r - width // 2, n - width), 0) for r in chosen]
    return [any(s <= r < s + width for s in starts) for r in range(n)]


@pytest.mark.parametrize(("ratio", "width"), [(0.3, 3), (0.1, 4), (0.5, 1), (0.2, 7), (1.0, 3), (0.0, 2)])
def test_bands_are_laid_in_the_task_that_holds_the_gather(spark, ratio, width):
    """A join by row dealt the gathers out again, by the number of shuffle partitions."""
    sizes = dict(enumerate((1, 2, 3, 4, 5, 8, 13, 40, 61)))
    given = spark.createDataFrame([(k, r, n) for k, n in sizes.items() for r in range(n)], "k long, rank long, n long")
    out = labels.trace_mask(given.repartition(3, "k"), ["k"], ratio, width, "5")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r.k, r["rank"]): r.masked for r in out.collect()}
    assert got == {(k, r): m for k, n in sizes.items() for r, m in enumerate(plain(n, ratio, width, "5"))}


def test_rows_without_a_key_have_no_bands(spark):
    given = spark.createDataFrame([(None, r, 20) for r in range(20)], "k long, rank long, n long")
    assert not any(r.masked for r in labels.trace_mask(given, ["k"], 0.3, 3, "5").collect())
