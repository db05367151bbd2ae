"""Moving sums, detectors and stacking over long-form samples (trace, t, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.gathers import starts_over


def frame(keys: list[str], lo: int, hi: int):
    return Window.partitionBy(*keys).orderBy("t").rowsBetween(lo, hi)


def box(rows: DataFrame, keys: list[str], width: int) -> Column:
    """Moving average that divides by the full width at the edges too."""
    left = (width - 1) // 2
    return F.sum("x").over(frame(keys, -(width - 1 - left), left)) / width


def sta_lta(rows: DataFrame, keys: list[str], ns: int, nl: int, eps: float = 1e-12) -> Column:
    """Ratio of short to long mean square, growing windows at the start."""
    e = F.col("x") * F.col("x")
    short, long = F.avg(e).over(frame(keys, -(ns - 1), 0)), F.avg(e).over(frame(keys, -(nl - 1), 0))
    return F.when(long > eps, short / long).otherwise(F.lit(0.0))


def agc(rows: DataFrame, keys: list[str], win: int, target: float, eps: float, most: float) -> Column:
    """Causal automatic gain: x times the clipped target over the moving rms."""
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")).over(frame(keys, -(win - 1), 0)))
    return F.col("x") * F.least(F.lit(target) / (rms + eps), F.lit(most))


def islands(rows: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Runs of consecutive t where flag holds: keys, start, length."""
    on = rows.where(flag)
    w = Window.partitionBy(*keys).orderBy("t")
    runs = on.withColumn("_g", F.col("t") - F.row_number().over(w))
    return runs.groupBy(*keys, "_g").agg(F.min("t").alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def majority_event(ratio: DataFrame, keys: list[str], thr: float, min_traces: int, min_len: int) -> DataFrame:
    """Stretches of t where at least min_traces traces of a gather reach thr, min_len long."""
    count = ratio.groupBy(*keys, "t").agg(F.sum((F.col("ratio") >= thr).cast("long")).alias("n"))
    return islands(count, keys, F.col("n") >= min_traces).where(F.col("length") >= min_len)


def event_probability(rows: DataFrame, keys: list[str], half: int) -> Column:
    """1 - exp(-window sum)."""
    return 1 - F.exp(-F.sum("p").over(frame(keys, -half, half)))


def residual_confidence(rows: DataFrame, keys: list[str], half: int, sigma: float, min_count: int) -> Column:
    """exp(-local variance / sigma^2) of r over rows within half; 0 where too few count."""
    w = Window.partitionBy(*keys).orderBy("trace_idx").rowsBetween(-half, half)
    n, s, q = F.count("r").over(w), F.sum("r").over(w), F.sum(F.col("r") * F.col("r")).over(w)
    var = F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))
    return F.when(n >= min_count, F.exp(-var / (sigma * sigma))).otherwise(F.lit(0.0))


def hann(t: Column, size: int, floor: float = 1e-3) -> Column:
    return F.greatest(0.5 - 0.5 * F.cos(2 * F.pi() * t / F.lit(max(1, size - 1))), F.lit(floor))


def tile_starts(n: Column, tile: int, overlap: int) -> Column:
    """Starts tile - overlap apart; the last tile is flush with the edge."""
    last = F.greatest(n - tile, F.lit(0).cast("long"))
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(tile - overlap).cast("long")), F.array(last))))


def tiled(rows: DataFrame, n: Column, tile: int, overlap: int) -> DataFrame:
    """Each sample once per tile that covers it."""
    return rows.withColumn("tile", F.explode(starts_over(F.col("t"), n, tile, tile - overlap)))


def blended(scored: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Weighted mean of the tiles' values y."""
    w = hann(F.col("t") - F.col("tile"), tile)
    return scored.withColumn("_w", w).groupBy(*keys, "t").agg((F.sum(F.col("_w") * F.col("y")) / F.sum("_w")).alias("y"), F.count(F.lit(1)).alias("tiles"))
