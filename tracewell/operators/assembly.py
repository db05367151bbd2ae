"""The trend of a survey put together: local where it can be trusted, drawn between, else global."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import gathers, series, trend


@dataclass(frozen=True)
class AssemblyKnobs:
    """Sizes in samples and traces unless named otherwise."""

    n_samples: int
    diff_th: float = 128.0
    inv_drop: float = 10.0
    inv_steps: int = 2
    discard_radius: int = 32
    dt: float = 0.002
    sigma_ms: float = 6.0
    var_half: int = 8
    var_sigma_ms: float = 6.0
    var_least: int = 3
    v_min: float = 300.0
    v_max: float = 6000.0
    slope_eps: float = 1e-6
    side_least: int = 16


def _inside(c: Column, n: int) -> Column:
    """A finite value within 1 .. n - 1; null for null and NaN."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.least(F.greatest(c.cast("double"), F.lit(1.0)), F.lit(n - 1.0)))


def side_inversions(rows: DataFrame, keys: list[str], value: str, drop: float, steps: int) -> Column:
    """Whether the row's side (sign of signed) of the gather has steps falls in a row of more than drop, by distance, over rows with a value."""
    part = Window.partitionBy(*keys, F.signum("signed"), F.col(value).isNotNull())
    order = part.orderBy(F.abs("signed"), "trace_idx")
    fall = lambda k: F.coalesce(F.lag(value, k).over(order) - F.lag(value, k - 1).over(order) > drop, F.lit(False))
    run = fall(1)
    for k in range(2, steps + 1):
        run = run & fall(k)
    on = F.col(value).isNotNull() & F.coalesce(F.col("signed") != 0, F.lit(False))
    # two windows follow one another, so the run is a column before its maximum is taken
    return F.when(on, run).otherwise(F.lit(False))


def assembled(rows: DataFrame, keys: list[str], local: str, whole: str, k: AssemblyKnobs) -> DataFrame:
    """rows with trend_i and where it comes from.

    rows hold trace_idx, signed (offset with the side as its sign, null where
    missing), a local and a global trend in samples (null or NaN where missing).
    The global trend of a trace without one is that of the nearest trace of the
    gather (the earlier of two). A local value is discarded where it is diff_th or
    more from the global one on a side whose local times fall with distance, and
    on traces within discard_radius of such a one. What is missing or discarded
    is drawn, by place, between the next kept traces of the side if they do not
    fall; else it is global.

    Adds trend_global_i, global_filled, discarded, source (local, between,
    global), trend_i. A trace at distance 0 belongs to no side and keeps its local
    value. Every gather is sorted by windows; nothing is collected.
    """
    rows = rows.withColumn("_l", F.when(F.col(local) > 0, _inside(F.col(local), k.n_samples))).withColumn("_g", _inside(F.col(whole), k.n_samples))
    rows = gathers.nearest_fill(rows, keys, "trace_idx", "_g", "trend_global_i")
    rows = rows.withColumn("global_filled", F.col("_g").isNull() & F.col("trend_global_i").isNotNull())
    rows = rows.withColumn("_run", side_inversions(rows, keys, "_l", k.inv_drop, k.inv_steps))
    falls = F.max("_run").over(Window.partitionBy(*keys, F.signum("signed"), F.col("_l").isNotNull()))
    far = F.coalesce(F.abs(F.col("trend_global_i") - F.col("_l")) >= k.diff_th, F.lit(False))
    rows = rows.withColumn("_seed", falls & far & F.coalesce(F.col("signed") != 0, F.lit(False)))
    rows = rows.withColumn("discarded", trend.dilated(rows, keys, "_seed", k.discard_radius))
    kept = F.when(F.col("_l").isNotNull() & ~F.col("discarded"), F.col("_l"))

    side = Window.partitionBy(*keys, F.signum("signed")).orderBy(F.abs("signed"), "trace_idx")
    rows = rows.withColumn("rank_on_side", F.row_number().over(side)).withColumn("_kept", kept)
    have = F.when(F.col("_kept").isNotNull(), F.struct(F.col("rank_on_side").alias("r"), F.col("_kept").alias("v")))
    near = [have, [*keys, F.signum("signed")], [F.abs("signed"), F.col("trace_idx")], 1]
    rows = rows.withColumn("_a", gathers.next_after(*near)).withColumn("_b", gathers.last_before(*near))
    share = (F.col("rank_on_side") - F.col("_b.r")) / (F.col("_a.r") - F.col("_b.r"))
    between = F.when(F.col("_b.v") <= F.col("_a.v"), (1 - share) * F.col("_b.v") + share * F.col("_a.v"))
    as_it_is = F.col("_kept").isNotNull() | F.coalesce(F.col("signed") == 0, F.lit(False))
    source = F.when(as_it_is, "local").when(F.col("signed").isNotNull() & between.isNotNull(), "between").otherwise("global")
    value = F.when(as_it_is, F.col("_l")).when(F.col("signed").isNotNull() & between.isNotNull(), between).otherwise(F.col("trend_global_i"))
    out = rows.withColumn("source", source).withColumn("trend_i", _inside(value, k.n_samples))
    return out.drop("_l", "_g", "_run", "_seed", "_kept", "_b", "_a", "rank_on_side")


def trend_confidence(rows: DataFrame, files: list[str], pick: str, trend_i: str, k: AssemblyKnobs) -> DataFrame:
    """rows with conf_trend: nearness of the pick to the trend times calm of the residual among the file's traces around; 0 without both."""
    good = (F.col(pick) > 0) & (F.col(pick) < k.n_samples) & (F.col(trend_i) > 0)
    rows = rows.withColumn("r", F.when(good, (F.col(pick) - F.col(trend_i)) * k.dt))
    calm = series.residual_confidence(rows, files, k.var_half, k.var_sigma_ms * 1e-3, k.var_least)
    near = F.exp(-F.pow(F.col("r") / (k.sigma_ms * 1e-3), 2))
    return rows.withColumn("conf_trend", F.when(F.col("r").isNotNull(), near * calm).otherwise(0.0)).drop("r")


def with_global_trend(rows: DataFrame, files: list[str], pick: str, weight: Column, k: AssemblyKnobs) -> DataFrame:
    """rows with trend_file_i: the global trend of the file's valid picks in samples, by side; null where no pick has weight.

    rows hold signed.
    """
    good = (F.col(pick) > 0) & (F.col(pick) < k.n_samples) & F.coalesce(F.abs("signed") > 0, F.lit(False))
    rows = rows.withColumn("_x", F.abs("signed")).withColumn("_w", F.when(good & (weight > 0), weight).otherwise(0.0))
    out = trend.global_trend(rows, files, "_x", "signed", F.col(pick) * k.dt, F.col("_w"), k.v_min, k.v_max, k.slope_eps, k.side_least)
    return out.withColumn("trend_file_i", F.col("trend") / k.dt).drop("_x", "_w", "trend", "own")
