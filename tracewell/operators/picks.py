"""Pick operators: snapping, confidences, trough shifts, consensus, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.signal import let, total
from tracewell.operators import views


def _nearest(candidates: Column, at: Column) -> Column:
    """The candidate closest to `at`, the earlier one on ties; null without any."""
    return F.array_min(F.transform(candidates, lambda c: F.struct(F.abs(c - at).alias("d"), c.alias("c"))))["c"]


def negated(a: Column) -> Column:
    return F.transform(a, lambda v: -v)


def _peak(a: Column, p: Column, reach: int) -> Column:
    lo, hi = F.greatest(p - reach, F.lit(0)), F.least(p + reach, F.size(a) - 1)
    steps = F.sequence(lo, hi)
    inner = F.filter(steps, lambda i: (i > lo) & (i < hi) & (F.get(a, i) > F.get(a, i - 1)) & (F.get(a, i) > F.get(a, i + 1)))
    highest = let(F.array_max(F.slice(a, lo + 1, hi - lo + 1)), lambda top: F.filter(steps, lambda i: F.get(a, i) == top))
    return F.coalesce(_nearest(inner, p), _nearest(highest, p))


def _rising(a: Column, p: Column) -> Column:
    back = F.array_max(F.filter(F.sequence(F.lit(0), p), lambda i: F.get(a, i) <= 0))
    ahead = F.array_min(F.filter(F.sequence(p, F.size(a) - 1), lambda i: F.get(a, i) >= 0))
    return F.coalesce(F.when(F.get(a, p) > 0, back).when(F.get(a, p) < 0, ahead), p)


def snap(a: Column, pick: Column, mode: str, reach: int = 5) -> Column:
    """The pick moved to the nearest phase of its trace.

    peak and trough take the nearest local extremum within reach, else the
    extreme value there; rising and trailing take the nearest zero crossing of
    that slope. Pick 0 stays 0; a pick outside the trace gives null.
    """
    p = pick.cast("int")
    form = {"peak": lambda: _peak(a, p, reach), "trough": lambda: _peak(negated(a), p, reach), "rising": lambda: _rising(a, p), "trailing": lambda: _rising(negated(a), p)}[mode]
    return F.when(p == 0, F.lit(0)).when((p > 0) & (p < F.size(a)), form()).cast("long")


def window_confidence(prob: Column, pick: Column, half: int, m0: float, eps: float = 1e-12) -> Column:
    """(1 - entropy) x clipped margin of the two highest values within half of the pick; 0 without a pick."""
    p = pick.cast("int")
    lo, hi = F.greatest(p - half, F.lit(0)), F.least(p + half, F.size(prob) - 1)
    part = F.slice(prob, lo + 1, hi - lo + 1)

    def of(w: Column) -> Column:
        n = F.size(w)
        h = -total(F.transform(w, lambda v: v * F.log(F.greatest(v, F.lit(eps)))))
        flat = F.when(n > 1, F.least(F.greatest(h / F.log(n.cast("double")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        down = F.sort_array(w, asc=False)
        margin = F.get(down, F.lit(0)) - F.coalesce(F.get(down, F.lit(1)), F.lit(0.0))
        return (1 - flat) * F.least(F.greatest(margin / m0, F.lit(0.0)), F.lit(1.0))

    share = let(total(part), lambda s: F.when(s > 0, F.transform(part, lambda v: v / F.greatest(s, F.lit(eps)))))
    return F.when((p > 0) & (p < F.size(prob)), F.coalesce(let(share, of), F.lit(0.0))).otherwise(0.0)


def statics_confidence(delta: Column, c: Column, valid: Column, c_th: float, max_lag: float) -> Column:
    part = F.least(F.greatest((c - c_th) / max(1 - c_th, 1e-6), F.lit(0.0)), F.lit(1.0))
    near = F.exp(-F.pow(F.abs(delta) / max_lag, 2)) if max_lag > 0 else F.lit(1.0)
    return F.when(valid, part * near).otherwise(0.0)


def smoothed3(a: Column) -> Column:
    """Mean of three samples, the edge samples repeated."""
    n = F.size(a)
    steps = F.sequence(F.lit(0), n - 1)
    return F.transform(steps, lambda i: (F.get(a, F.greatest(i - 1, F.lit(0))) + F.get(a, i) + F.get(a, F.least(i + 1, n - 1))) / 3)


def trough_shift(rows: DataFrame, pick: str, samples: str, max_shift: int, scan: int, a_th: float) -> DataFrame:
    """Moves a pick to the trough before the first strong peak after it.

    Adds peak_i, trough_i (-1 where there is none), shifted and reason: p_oob,
    scale0, scan_empty, no_pos_peak, no_trough, trough_too_far or shifted.
    """
    p, n = F.col(pick).cast("int"), F.size(samples)
    top = F.array_max(F.transform(samples, F.abs))
    last = F.least(n - 2, p + scan)
    reason = F.when((p <= 0) | (p >= n - 2), "p_oob").when(~(F.col("_top") > 0), "scale0").when(last <= p + 1, "scan_empty")
    out = rows.withColumn("_top", top).withColumn("_why", reason)
    out = out.withColumn("_v", F.when(F.col("_why").isNull(), smoothed3(F.transform(samples, lambda x: x / F.col("_top")))))
    v = lambda i: F.get("_v", i)
    peaks = F.filter(F.sequence(p + 1, last), lambda i: (v(i - 1) < v(i)) & (v(i) >= v(i + 1)) & (v(i) >= a_th))
    out = out.withColumn("peak_i", F.when(F.col("_why").isNull(), F.array_min(peaks)))
    troughs = F.filter(F.sequence(p, F.col("peak_i") - 1), lambda i: (i > p) & (v(i - 1) > v(i)) & (v(i) <= v(i + 1)))
    out = out.withColumn("trough_i", F.when(F.col("peak_i").isNotNull(), F.array_max(troughs)))
    far = F.col("trough_i") - p > max_shift
    why = F.coalesce("_why", F.when(F.col("peak_i").isNull(), "no_pos_peak").when(F.col("trough_i").isNull(), "no_trough").when(far, "trough_too_far").otherwise("shifted"))
    out = out.withColumn("reason", why).withColumn("shifted", F.when(why == "shifted", F.col("trough_i")).otherwise(p).cast("long"))
    minus = {c: F.coalesce(F.col(c), F.lit(-1)).cast("long") for c in ("peak_i", "trough_i")}
    return out.withColumns(minus).drop("_top", "_why", "_v")


def median(a: Column) -> Column:
    """Mean of the two middle values; null for an empty array."""
    half = lambda s, k: F.get(s, F.floor((F.size(s) - k) / 2).cast("int"))
    return let(F.array_sort(a), lambda s: (half(s, 1) + half(s, 0)) / 2)


def consensus(rows: DataFrame, keys: list[str], order: str, radius: int, support: int, most_dev: int, most_shift: int, pin_tol: int) -> DataFrame:
    """Corrects shifts (p_post - p_in) that differ from their moved neighbours' median.

    A trace that did not move takes the median when its own p_in is within
    pin_tol of theirs. Adds p_out; at most 2 radius + 1 rows meet at a time.
    """
    d = F.when((F.col("p_in") > 0) & (F.col("p_post") > 0), F.col("p_post") - F.col("p_in")).otherwise(0)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)
    rows = rows.withColumn("_d", d)
    near = F.collect_list(F.struct(F.col(order).alias("o"), F.col("_d").alias("d"), F.col("p_in").alias("p"))).over(w)
    rows = rows.withColumn("_n", near).withColumn("_n", F.filter("_n", lambda e: (e["d"] != 0) & (e["o"] != F.col(order))))
    rows = rows.withColumn("_m", median(F.transform("_n", lambda e: e["d"].cast("double")))).withColumn("_p", median(F.transform("_n", lambda e: e["p"].cast("double"))))
    to = F.col("p_in") + F.least(F.greatest(F.rint("_m"), F.lit(0)), F.lit(most_shift)).cast("long")
    enough = F.size("_n") >= max(1, support)
    spread = enough & (F.col("_d") == 0) & (F.abs(F.col("p_in") - F.col("_p")) <= pin_tol)
    fix = enough & (F.col("_d") != 0) & (F.abs(F.col("_d") - F.col("_m")) > most_dev)
    return rows.withColumn("p_out", F.when(spread | fix, to).otherwise(F.col("p_post"))).drop("_d", "_n", "_m", "_p")


def projected(rows: DataFrame, keys: list[str], flip: bool, factor_h: float, factor: float, start: int, width: int) -> DataFrame:
    """Picks and offsets of gather rows seen in a flipped, stretched, cut view.

    rows hold rank, n (rows of the gather), fb and offset_m. Row r of the view
    shows the nearest source row's pick, -1 outside 1..width-1, and the offset
    interpolated between the two source rows around it.
    """
    view = F.struct(F.lit(flip).alias("hflip"), F.lit(float(factor_h)).alias("factor_h"), F.lit(float(factor)).alias("factor"), F.lit(start).alias("start"))
    views_of = rows.select(*keys, "rank", "n", view.alias("view"), F.lit(0).cast("long").alias("tshift"))
    return views.projected(rows, views_of, keys, width)


def weighted_median(values: Column) -> Column:
    """Of structs (v, w): the least v whose cumulated weight reaches half of all; 0 without weight."""
    all_w = F.aggregate(values, F.lit(0.0), lambda s, e: s + e["w"])
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v"))

    def of(whole: Column) -> Column:
        step = lambda s, e: F.struct((s["c"] + e["w"]).alias("c"), F.coalesce(s["v"], F.when(s["c"] + e["w"] >= 0.5 * whole, e["v"])).alias("v"))
        return F.when(whole > 0, F.aggregate(F.array_sort(values), zero, step, lambda s: s["v"])).otherwise(0.0)

    return let(all_w, of)
