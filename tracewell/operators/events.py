"""Event operators over gathers: support curves, peaks, scores, clusters, noise decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.signal import hysteresis
from tracewell.operators.series import frame, majority_event


def support(rows: DataFrame, keys: list[str], half: int) -> DataFrame:
    """keys, t, s: mean over the traces of p's windowed mean (divided by the full window)."""
    m = F.sum("p").over(frame([*keys, "trace_idx"], -half, half)) / (2 * half + 1)
    return rows.withColumn("_m", m).groupBy(*keys, "t").agg(F.avg("_m").alias("s"))


def edge_mean(keys: list[str], value: str, width: int) -> Column:
    """Moving average over width samples from t = 0, edge values repeated."""
    left = width // 2
    right = width - 1 - left
    every = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max("t").over(every)
    before, after = F.greatest(left - F.col("t"), F.lit(0)), F.greatest(F.col("t") + right - last, F.lit(0))
    return (F.sum(value).over(frame(keys, -left, right)) + before * F.first(value).over(every) + after * F.last(value).over(every)) / width


def peaks(curve: DataFrame, keys: list[str], min_score: float, distance: int, width: int) -> DataFrame:
    """keys, t, s of the peaks of a curve (keys, t, s) after smoothing.

    A peak reaches min_score, is the highest within distance and exceeds its
    left neighbour. Peaks that close to each other are equal in height; of
    such a chain every next one beyond distance of the last kept stays.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    rows = curve.withColumn("s", edge_mean(keys, "s", width) if width > 1 else F.col("s"))
    rows = rows.withColumn("_top", F.max("s").over(frame(keys, -distance, distance))).withColumn("_l", F.lag("s").over(w)).withColumn("_r", F.lead("s").over(w))
    rises = F.col("_l").isNull() | (F.col("s") > F.col("_l"))
    holds = F.col("_r").isNull() | (F.col("s") >= F.col("_r")) if distance == 0 else F.lit(True)
    found = rows.where((F.col("s") >= min_score) & (F.col("s") == F.col("_top")) & rises & holds)
    far = F.coalesce((F.col("t") - F.lag("t").over(w) > distance).cast("long"), F.lit(1))
    chain = found.withColumn("_far", far).withColumn("_c", F.sum("_far").over(w)).groupBy(*keys, "_c").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.max("s").alias("s"))
    zero = F.expr("cast(array() as array<int>)")
    kept = F.aggregate(F.col("ts").cast("array<int>"), zero, lambda k, t: F.when((F.size(k) == 0) | (t - F.element_at(k, F.greatest(F.size(k), F.lit(1))) > distance), F.concat(k, F.array(t))).otherwise(k))
    return chain.select(*keys, F.explode(kept).alias("t"), "s")


def scores(found: DataFrame, rows: DataFrame, keys: list[str], left: int, right: int, weight: Column) -> DataFrame:
    """keys, t, score: weighted mean over traces of 1 - exp(-sum of p within the peak's window)."""
    near = found.select(*keys, F.col("t").alias("peak"), F.explode(F.sequence(F.col("t") - left, F.col("t") + right)).alias("t"))
    by = near.join(rows.withColumn("_w", weight), [*keys, "t"]).groupBy(*keys, "peak", "trace_idx").agg((1 - F.exp(-F.sum("p"))).alias("q"), F.first("_w").alias("_w"))
    return by.groupBy(*keys, F.col("peak").alias("t")).agg((F.sum(F.expr("_w * q")) / F.sum("_w")).alias("score"))


def pulled_sum(a: Column, win: int) -> Column:
    """Sum of win values around each t, starting win // 2 before it; windows at the edges are moved inside."""
    n = F.size(a)

    def at(t: Column) -> Column:
        start = F.greatest(F.least(F.greatest(t - win // 2, F.lit(0)), n - win), F.lit(0))
        return F.aggregate(F.slice(a, start + 1, F.lit(win)), F.lit(0).cast("long"), lambda s, v: s + v)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def pick_clusters(ratios: DataFrame, keys: list[str], on: float, off: float, min_on: int, refractory: int, win: int, min_traces: int) -> DataFrame:
    """keys, counts (trigger starts per t), clusters, is_event of traces (keys, ratio array).

    Starts are counted per gather and t before a gather's curve is built.
    """
    hits = ratios.select(*keys, F.size("ratio").alias("n"), hysteresis(F.col("ratio"), on, off, min_on, refractory).alias("h"))
    length = hits.groupBy(*keys).agg(F.max("n").alias("n"))
    count = hits.select(*keys, F.explode("h").alias("t")).groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("c"))
    curve = count.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("t", "c"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda t: F.coalesce(F.element_at("m", t), F.lit(0).cast("long")))
    out = length.join(curve, keys, "left").withColumn("counts", dense).withColumn("clusters", pulled_sum(F.col("counts"), win))
    return out.select(*keys, "counts", "clusters", (F.array_max("clusters") >= min_traces).alias("is_event"))


def noise_decision(ratios: DataFrame, keys: list[str], cluster: dict, majority: dict) -> DataFrame:
    """keys, decision of traces (keys, ratio array): reject_B by clusters first, reject_A by majority, else noise."""
    b = pick_clusters(ratios, keys, **cluster).select(*keys, F.col("is_event").alias("b"))
    long = ratios.select(*keys, F.posexplode("ratio").alias("t", "ratio"))
    a = majority_event(long, keys, **majority).select(*keys).distinct().withColumn("a", F.lit(True))
    return b.join(a, keys, "left").select(*keys, F.when(F.col("b"), "reject_B").when(F.col("a"), "reject_A").otherwise("noise").alias("decision"))


def parabolic_argmax(p: Column) -> Column:
    """Index of the maximum refined by the parabola through its neighbours; edges and flat tops as they are."""
    k = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    y0, y1, y2 = F.when(k > 0, F.get(p, k - 1)), F.get(p, k), F.get(p, k + 1)
    bend = y0 - 2 * y1 + y2
    return k + F.coalesce(F.when(bend < 0, 0.5 * (y0 - y2) / bend), F.lit(0.0))

