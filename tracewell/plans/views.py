"""The given tables as trace tables, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.gathers import spread

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]

HDR = f"""hdr as materialized (select l_suppkey as file_id, l_orderkey % 16 as ffid, l_partkey % 200 as chno, l_partkey % 50 as cmp, l_extendedprice / 10 as offset_m,
 case when l_discount < 0.02 then 0 else cast(floor(l_quantity * 10) as bigint) end as fb, l_linenumber as line,
 row_number() over (partition by l_suppkey order by {", ".join(ORDER)}) - 1 as trace_idx from lineitem)"""
WAVE = "wave as (select vec_id as trace_idx, cast(label as bigint) as ffid, (vec_id * 37) % 1000 as offset_m, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) - 1 as t from embeddings)"
SHOT = "shot as (select s_suppkey as shot, (s_suppkey * 7919) % 10007 as sx, (s_suppkey * 104729) % 10009 as sy, s_nationkey as line from supplier)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_hdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, ffid, chno, cmp, offset_m, fb, line, trace_idx."""
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.repartition(spread(spark, rows.count(), 150_000), "l_suppkey")
    index = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)) - 1
    fb = F.when(F.col("l_discount") < 0.02, F.lit(0)).otherwise(F.floor(F.col("l_quantity") * 10)).cast("long")
    return rows.select(
        F.col("l_suppkey").alias("file_id"), (F.col("l_orderkey") % 16).alias("ffid"), (F.col("l_partkey") % 200).alias("chno"), (F.col("l_partkey") % 50).alias("cmp"),
        (F.col("l_extendedprice") / 10).alias("offset_m"), fb.alias("fb"), F.col("l_linenumber").alias("line"), index.cast("long").alias("trace_idx"),
    )


def trace_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_idx, ffid, offset_m, samples (array<double>)."""
    samples = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trace_idx"), F.col("label").cast("long").alias("ffid"), ((F.col("vec_id") * 37) % 1000).alias("offset_m"), samples.alias("samples"))


def trace_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: trace_idx, ffid, offset_m, t, x."""
    return trace_wave(spark, sf_dir).select("trace_idx", "ffid", "offset_m", F.posexplode("samples").alias("t", "x"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("shot"), ((F.col("s_suppkey") * 7919) % 10007).alias("sx"), ((F.col("s_suppkey") * 104729) % 10009).alias("sy"), F.col("s_nationkey").alias("line"))
