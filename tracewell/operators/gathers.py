"""Gathers: order, grouping, windows, padding, sampling, lookups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spread(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of about so many rows each, one a core at least: a task's share does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def ordered(rows: DataFrame, keys: list[str], secondary: str, primary: str) -> DataFrame:
    """rank (from 0) in the gather: by secondary, ties by primary, then file order."""
    w = Window.partitionBy(*keys).orderBy(secondary, primary, "trace_idx")
    return rows.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def window_starts(n: Column, win: int, stride: int) -> Column:
    """0, stride, ...; the last window is pulled back to the end."""
    last = F.greatest(n - win, F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))))


def starts_over(rank: Column, n: Column, win: int, stride: int) -> Column:
    """Of the window_starts those whose window holds the rank: at most win / stride + 1, however long the gather."""
    last = F.greatest(n - win, F.lit(0))
    lo = F.greatest(F.ceil((rank - (win - 1)) / stride), F.lit(0)).cast("long")
    hi = F.least(F.floor(rank / stride), F.floor(last / stride)).cast("long")
    none = F.expr("cast(array() as array<bigint>)")
    regular = F.when(lo <= hi, F.transform(F.sequence(F.least(lo, hi), hi), lambda k: k * stride)).otherwise(none)
    return F.array_distinct(F.concat(regular, F.when(rank >= last, F.array(last.cast("long"))).otherwise(none)))


def trace_windows(ranked: DataFrame, keys: list[str], win: int, stride: int) -> DataFrame:
    """One row per trace and window: start and row inside the window."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = ranked.withColumn("_n", n).withColumn("start", F.explode(starts_over(F.col("rank"), F.col("_n"), win, stride)))
    return rows.withColumn("row", F.col("rank") - F.col("start")).drop("_n")


def padded(rows: DataFrame, keys: list[str], win: int) -> DataFrame:
    """Every window filled up to win rows: trace_idx -1, offset 0, fb -1, trace_valid false."""
    frame = rows.select(*keys).distinct().withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(win - 1).cast("long"))))
    out = frame.join(rows, [*keys, "row"], "left").withColumn("trace_valid", F.col("trace_idx").isNotNull())
    return out.fillna({"trace_idx": -1, "offset_m": 0.0, "fb": -1})


def last_before(have: Column, keys: list, order: list[Column], skip: int = 0) -> Column:
    """The last value so far that is not null, skip rows before this one at least."""
    return F.last(have, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*[c.asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -skip))


def next_after(have: Column, keys: list, order: list[Column], skip: int = 0) -> Column:
    """The first value from here on that is not null, by the reversed order: a frame that only ends later is read once."""
    return F.last(have, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -skip))


def nearest_fill(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Missing values take the nearest present one by order, the earlier on a tie."""
    have = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    before, after = last_before(have, keys, [F.col(order)]), next_after(have, keys, [F.col(order)])
    rows = rows.withColumn("_a", after).withColumn("_b", before)
    nearer = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col(order) - F.col("_b.o") <= F.col("_a.o") - F.col(order)))
    return rows.withColumn(out, F.when(nearer, F.col("_b.v")).otherwise(F.col("_a.v"))).drop("_b", "_a")


def signed_offset(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before the one of least offset get a negative sign; missing offsets stay missing."""
    at = F.min(F.when(F.col("offset_m").isNotNull(), F.struct("offset_m", "rank"))).over(Window.partitionBy(*keys))
    return ranked.withColumn("signed_offset", F.when(F.col("rank") < at["rank"], -F.col("offset_m")).otherwise(F.col("offset_m")))


def uniform(*cols: Column) -> Column:
    """A replayable uniform number from a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def exact_mix(rows: DataFrame, period: int, share: float, seed: str) -> DataFrame:
    """Of every period rows (by i) exactly round(share * period) are noise."""
    block = F.floor(F.col("i") / period)
    w = Window.partitionBy(block).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("i"))), "i")
    return rows.withColumn("noise", F.row_number().over(w) <= round(share * period))


def knn(points: DataFrame, k: int, cell: float) -> DataFrame:
    """k nearest other points of each point by squared distance, ties by id. points: id, x, y."""
    ranked = knn_pairs(points, k, cell).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("d2", "b"))).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "d2", F.col("rank").cast("long").alias("rank"))


def knn_pairs(points: DataFrame, k: int, cell: float) -> DataFrame:
    """a, b, d2: pairs among which the k nearest of each point are.

    Cells of cell, halved or doubled over and over, make levels
    from two points a cell, if all lay on one line, up to one cell for all. A point is served at the
    level above the finest one at which its own cell holds more than k points:
    the k-th neighbour is within the diagonal of that cell, so in the 3x3 cells
    around at the level above. The pairs grow with the points where the density
    changes little from a cell to the next; a lone point beside a crowded cell is
    compared with all of that cell.
    """
    spark = points.sparkSession
    n, wide = points.agg(F.count(F.lit(1)), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()
    cells = math.log2(max(wide or 0.0, cell) / cell)
    fine, top = math.floor(cells - math.log2(max(n, 2) / 2)), math.floor(cells) + 1
    level, width = F.explode(F.sequence(F.lit(fine), F.lit(top))).alias("level"), F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level"))
    at = [F.floor(F.col(c) / width).cast("long").alias(f"c{c}") for c in ("x", "y")]
    placed = points.repartition(spread(spark, n, 20_000)).select("id", "x", "y", level).select("*", *at)
    full = placed.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("level", "cx", "cy")
    own = placed.join(full, ["level", "cx", "cy"]).groupBy("id").agg(F.min("level").alias("level"))
    served = points.join(own, "id", "left").select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.least(F.coalesce(F.col("level") + 1, F.lit(top)), F.lit(top)).alias("level"))
    mine = [F.floor(F.col(f"a{c}") / width).cast("long") for c in ("x", "y")]
    around = F.array(*[F.struct((mine[0] + i).alias("cx"), (mine[1] + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = served.select("a", "ax", "ay", "level", F.explode(around).alias("c")).select("a", "ax", "ay", "level", "c.*")
    near = near.repartition(spread(spark, n, 2_000), "level", "cx", "cy")
    d2 = (F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2
    return near.join(placed, ["level", "cx", "cy"]).where("id <> a").select("a", F.col("id").alias("b"), d2.alias("d2"))


def merged_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching (a, z) intervals of a key made one."""
    w = Window.partitionBy(*keys).orderBy("a", "z")
    reach = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0)
    island = rows.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_g").agg(F.min("a").alias("a"), F.max("z").alias("z")).drop("_g")


def gaps(merged: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """What merged intervals leave free between lo and hi."""
    w = Window.partitionBy(*keys).orderBy("a")
    before = F.coalesce(F.lag("z").over(w), lo)
    inner = merged.select(*keys, before.alias("a"), F.col("a").alias("z"))
    tail = merged.groupBy(*keys).agg(F.max("z").alias("a")).withColumn("z", hi)
    return inner.unionByName(tail.select(*keys, "a", "z")).where("z > a")
