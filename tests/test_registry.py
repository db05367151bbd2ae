"""Every query with SQL gives what an independent engine gives on the smallest tables."""

import math

import duckdb
import pytest

from tracewell.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    return f"{x + 0.0:.5f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, engine, name):
    found = registry.queries()[name](spark, SF)
    asked = engine.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(asked.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    at = [asked.columns.index(c) for c in columns]
    want = sorted(tuple(plain(float(r[k]) if str(type(r[k])).endswith("Decimal'>") else r[k]) for k in at) for r in asked.fetchall())
    assert rows == want


def test_hysteresis_by_hand(spark):
    from pyspark.sql import functions as F

    from tracewell.functions.signal import hysteresis

    rows = spark.createDataFrame([([float(v) for v in (0, 2, 2, 2, 1, 0, 2, 2, 0, 0, 0, 2, 2)],)], "a array<double>")
    assert rows.select(hysteresis(F.col("a"), 1.5, 0.5, 2, 6)).first()[0] == [1, 11]


def test_standardize_of_flat_trace(spark):
    from pyspark.sql import functions as F

    from tracewell.functions.signal import standardize

    rows = spark.createDataFrame([([3.0, 3.0],)], "a array<double>")
    assert rows.select(standardize(F.col("a"))).first()[0] == [0.0, 0.0]
