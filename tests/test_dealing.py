import os
import re

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")
@pytest.mark.parametrize("name", ["velocity_inversion", "gate_windows", "reject_reasons", "trace_mask", "gathers_with_picks", "accepted_draws"])
def test_traces_are_dealt_once_by_file(spark, name):
    """What follows the dealing stays in its partitions; only counts of reasons are dealt again."""
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, \d+\), (\w+)", plan)
    assert plan.count("Exchange ") == len(found)
    assert found == [("reject_reason", "ENSURE_REQUIREMENTS")] * (name == "reject_reasons") + [("l_suppkey", "REPARTITION_BY_NUM")]
