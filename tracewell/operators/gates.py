"""Predicates and gates over traces and windows (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.signal import let


def valid_pick(pick: Column, n_samples: int | None = None, zero_is_invalid: bool = True) -> Column:
    ok = pick.isNotNull() & ~F.isnan(pick.cast("double")) & ((pick > 0) if zero_is_invalid else (pick >= 0))
    return ok & (pick < n_samples) if n_samples is not None else ok


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | key.between(lo, hi)
    return out


def window_gates(rows: DataFrame, keys: list[str], order: list[str], min_ratio: float, min_pairs: int, percentile: float, thresh_ms: float, dt_ms: float) -> DataFrame:
    """One row per window: counts, percentile of adjacent pick jumps in ms, verdict and reason."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = rows.withColumn("_p", F.lag("fb").over(w))
    jump = F.when((F.col("fb") > 0) & (F.col("_p") > 0), F.abs(F.col("fb") - F.col("_p")))
    out = step.withColumn("_d", jump).groupBy(*keys).agg(
        F.sum((F.col("fb") > 0).cast("long")).alias("n_valid"), F.avg((F.col("fb") > 0).cast("double")).alias("pick_ratio"),
        F.count("_d").alias("valid_pairs"), (F.percentile("_d", percentile / 100) * dt_ms).alias("p_ms"),
    )
    low, few = F.col("pick_ratio") < min_ratio, (F.col("valid_pairs") < min_pairs) | (F.col("p_ms") > thresh_ms)
    out = out.withColumn("reject_reason", F.when(low, "min_pick").when(few, "fblc").otherwise("ok"))
    return out.withColumn("accepted", F.col("reject_reason") == "ok")


def base_valid_bits(pick: Column, trend: Column, n_samples: int, half: int) -> Column:
    """Bit 0 bad pick, bit 1 bad trend, bit 2 unless both are good and close."""
    good_p, good_t = valid_pick(pick, n_samples), trend.isNotNull() & ~F.isnan(trend) & (trend > 0)
    near = good_p & good_t & (F.abs(pick - F.rint(trend)) < half)
    return (F.when(good_p, 0).otherwise(1) + F.when(good_t, 0).otherwise(2) + F.when(near, 0).otherwise(4)).cast("int")


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, as a fused multiply-add has it (for values far from overflow)."""
    halves = lambda v: let(v * F.lit(134217729.0), lambda t: F.struct((t - (t - v)).alias("h"), (v - (t - (t - v))).alias("l")))

    def exact(x: Column, y: Column) -> Column:
        p = a * b
        low = ((x["h"] * y["h"] - p) + x["h"] * y["l"] + x["l"] * y["h"]) + x["l"] * y["l"]
        s = p + c
        rest = (p - (s - (s - p))) + (c - (s - p))
        return s + (rest + low)

    return let(halves(a), lambda x: let(halves(b), lambda y: exact(x, y)))


def thresholds(rows: DataFrame, keys: list[str], scores: dict[str, str], share: float) -> DataFrame:
    """keys and, under each name of scores, the share percentile of its column.

    It is interpolated as SQL's quantile_cont does, to the last bit: a score of a
    row that does not count may equal it. Equal scores are counted first, so no key
    is collected. Null scores do not count.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("of"), F.col(c).cast("double").alias("v")) for name, c in scores.items()]))
    cells = rows.select(*keys, each.alias("_e")).select(*keys, "_e.*").where("v is not null").groupBy(*keys, "of", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, "of")
    cells = cells.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", (F.sum("n").over(w) - 1) * F.lit(share))
    first = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    ends = cells.groupBy(*keys, "of").agg(first(F.floor("at")).alias("lo"), first(F.ceil("at")).alias("hi"), F.first(F.col("at") - F.floor("at")).alias("w"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(fused(F.col("lo"), 1 - F.col("w"), F.col("hi") * F.col("w")))
    of = lambda name: F.max(F.when(F.col("of") == name, F.col("q"))).alias(name)
    return ends.withColumn("q", value).groupBy(*keys).agg(*[of(name) for name in scores])


def score_bits(scores: list[tuple[Column, Column]]) -> Column:
    """Bits 3, 4, ... for scores under their thresholds; a missing threshold keeps nothing."""
    out = F.lit(0)
    for k, (s, th) in enumerate(scores):
        out = out + F.when(s >= th, 0).otherwise(8 << k)
    return out.cast("int")


def drop_low_gathers(rows: DataFrame, keys: list[str], height: int) -> DataFrame:
    """Picks of gathers of fewer traces become 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("fb", F.when(n < height, F.lit(0)).otherwise(F.col("fb")).cast("long"))
