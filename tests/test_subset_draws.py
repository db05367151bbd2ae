"""Subset draws: shares of the kinds, and gathers shorter than wanted."""

from pyspark.sql import functions as F

from tracewell.operators import draws


def data(spark, n=60):
    return spark.range(n).select(F.lit(1).alias("f"), F.col("id").alias("trace_idx"), (F.col("id") % 4).alias("ffid"), F.floor(F.col("id") / 4).alias("chno"), (F.col("id") % 5).alias("cmp"), (F.col("id") * 7 % 11).cast("double").alias("offset_m"))


def test_shares_and_rows(spark):
    many = spark.range(3000).select(F.lit(1).alias("f"), F.col("id").alias("i"))
    out = draws.subset_draws(data(spark), many, ["f"], "i", {"ffid": 3.0, "chno": 1.0, "cmp": 0.0}, 6, "s").collect()
    per = {}
    for r in out:
        per.setdefault(r.i, []).append(r)
    assert len(per) == 3000 and {r.key_name for r in out} == {"ffid", "chno"}
    share = sum(rows[0].key_name == "ffid" for rows in per.values()) / 3000
    assert abs(share - 0.75) < 3 * (0.75 * 0.25 / 3000) ** 0.5
    for rows in per.values():
        # gathers of one ffid hold 15 traces, of one chno 4
        size = 6 if rows[0].key_name == "ffid" else 4
        assert sorted(r.row for r in rows) == list(range(size)) and {r.pad for r in rows} == {6 - size}
        assert len({r.trace_idx for r in rows}) == size


def test_without_weights_and_empty(spark):
    few = spark.range(40).select(F.lit(1).alias("f"), F.col("id").alias("i"))
    out = draws.subset_draws(data(spark), few, ["f"], "i", {"ffid": 0.0, "cmp": 0.0}, 3, "s", fixed=True)
    assert {(r.key_name, r.secondary) for r in out.collect()} == {("ffid", "chno"), ("cmp", "offset")}
    assert draws.subset_draws(data(spark, 0), few, ["f"], "i", {"ffid": 1.0}, 3, "s").count() == 0
