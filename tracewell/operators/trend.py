"""Lines, moveout, velocity checks and gaps (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.gathers import last_before, next_after


def weighted_line(rows: DataFrame, keys: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted least squares slope and intercept; flat through the mean where x does not vary."""
    r = rows.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"))
    s = r.groupBy(*keys).agg(F.sum("w").alias("sw"), F.sum(F.expr("w*x")).alias("sx"), F.sum(F.expr("w*y")).alias("sy"), F.sum(F.expr("w*x*x")).alias("sxx"), F.sum(F.expr("w*x*y")).alias("sxy"))
    det = F.expr("sw*sxx - sx*sx")
    slope = F.when(det > 1e-9, F.expr("sw*sxy - sx*sy") / det).otherwise(F.lit(0.0))
    out = s.where("sw > 0").withColumn("slope", slope)
    return out.select(*keys, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("intercept"))


def moveout(pick: Column, offset: Column, ref: float, velocity: float, dt: float) -> Column:
    return pick - F.abs(offset - ref) / velocity / dt


def inversions(rows: DataFrame, keys: list[str], drop: float, steps: int) -> DataFrame:
    """Marks runs of at least steps consecutive drops of time beyond drop, by absolute offset."""
    w = Window.partitionBy(*keys).orderBy(F.abs("offset_m"), "trace_idx")
    down = (F.lag("time").over(w) - F.col("time")) > drop
    rows = rows.withColumn("_d", F.coalesce(down, F.lit(False))).withColumn("_i", F.row_number().over(w))
    part = Window.partitionBy(*keys, "_d").orderBy("_i")
    rows = rows.withColumn("_g", F.col("_i") - F.row_number().over(part))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_d", "_g"))
    return rows.withColumn("inverted", F.col("_d") & (n >= steps)).drop("_d", "_i", "_g")


def dilated(rows: DataFrame, keys: list[str], mask: str, radius: int) -> Column:
    w = Window.partitionBy(*keys).orderBy("trace_idx").rowsBetween(-radius, radius)
    return F.max(F.col(mask).cast("int")).over(w) == 1


def filled_gaps(rows: DataFrame, keys: list[str], value: str) -> Column:
    """Linear by rank between present neighbours that do not decrease; null elsewhere."""
    have = F.when(F.col(value).isNotNull(), F.struct(F.col("rank").alias("r"), F.col(value).alias("v")))
    b, a = last_before(have, keys, [F.col("trace_idx")]), next_after(have, keys, [F.col("trace_idx")])
    part = (F.col("rank") - b["r"]) / F.greatest(a["r"] - b["r"], F.lit(1))
    return F.when(F.col(value).isNotNull(), F.col(value)).when(a["v"] >= b["v"], b["v"] + part * (a["v"] - b["v"]))


def cone(t: Column, offset: Column, v_min: float, v_max: float, lo: float, hi: float) -> Column:
    """Whether a time lies between the fastest and the slowest arrival."""
    x = F.abs(offset)
    return (t >= x / v_max + lo) & (t <= x / v_min + hi)


def two_piece(rows: DataFrame, keys: list[str], x: Column, y: Column, w: Column, bins: int = 10, least: int = 3) -> DataFrame:
    """keys, xb, a1, b1, a2, b2, single: two weighted lines that meet the data best on both sides of a break.

    Rows are summed once into bins of x; running sums of the bins give both
    sides of every break between two bins, so nothing is multiplied by the number
    of breaks. The break of the least squared error wins (the first of equals);
    where no break leaves least rows on both sides one line serves as both.
    """
    r = rows.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w")).where("w > 0 and x > 0")
    span = r.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    r = r.join(span, keys).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.expr("(x - lo) / greatest(hi - lo, 1e-9)") * bins)).cast("int"))
    names = {"n": "1", "sw": "w", "sx": "w*x", "sy": "w*y", "sxx": "w*x*x", "sxy": "w*x*y", "syy": "w*y*y"}
    cells = r.groupBy(*keys, "lo", "hi", "bin").agg(*[F.sum(F.expr(e)).cast("double").alias(c) for c, e in names.items()])
    cells = cells.join(cells.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))), [*keys, "bin"], "right").fillna(0.0, [*names])
    upto, whole = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    sides = cells.select(*keys, "bin", F.max("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"), *[F.sum(c).over(upto).alias(f"{c}1") for c in names], *[F.sum(c).over(whole).alias(f"{c}0") for c in names])
    sides = sides.withColumns({f"{c}2": F.col(f"{c}0") - F.col(f"{c}1") for c in names})

    def line(k: int) -> Column:
        s = {c: F.col(f"{c}{k}") for c in names}
        det = s["sw"] * s["sxx"] - s["sx"] * s["sx"]
        a = F.when(det > 1e-9, (s["sw"] * s["sxy"] - s["sx"] * s["sy"]) / det).otherwise(0.0)
        b = F.when(s["sw"] > 0, (s["sy"] - a * s["sx"]) / s["sw"]).otherwise(0.0)
        return F.struct(a.alias("a"), b.alias("b"), (s["syy"] - b * s["sy"] - a * s["sxy"]).alias("sse"))

    fits = sides.withColumns({"l1": line(1), "l2": line(2), "l0": line(0)})
    split = (F.col("n1") >= least) & (F.col("n2") >= least) & (F.col("bin") < bins - 1)
    xb = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 1) / bins
    best = F.min(F.when(split, F.struct((F.col("l1.sse") + F.col("l2.sse")).alias("sse"), "bin", xb.alias("xb"), "l1", "l2")))
    out = fits.groupBy(*keys).agg(best.alias("best"), F.first("l0").alias("l0"), F.first(F.expr("(lo + hi) / 2")).alias("mid"))
    pick = lambda c, d: F.coalesce(F.col(f"best.{c}"), F.col(d))
    return out.select(*keys, pick("xb", "mid").alias("xb"), pick("l1.a", "l0.a").alias("a1"), pick("l1.b", "l0.b").alias("b1"), pick("l2.a", "l0.a").alias("a2"), pick("l2.b", "l0.b").alias("b2"), F.col("best").isNull().alias("single"))


def projected_slopes(coef: DataFrame, v_min: float, v_max: float, eps: float) -> DataFrame:
    """Coefficients within the speeds allowed, the first slope steeper than the second by eps, pieces meeting at the break."""
    lo, hi = 1.0 / v_max, 1.0 / v_min
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))
    out = coef.withColumn("a1", clip("a1")).withColumn("a2", clip("a2"))
    lower, upper = F.least(F.col("a2"), F.col("a1") - eps), F.greatest(F.col("a1"), F.col("a2") + eps)
    fine = F.col("a1") > F.col("a2") + eps
    a2 = F.when(fine, F.col("a2")).when(lower >= lo, lower).when(upper <= hi, F.col("a2")).otherwise(lo)
    a1 = F.when(fine | (lower >= lo), F.col("a1")).when(upper <= hi, upper).otherwise(hi)
    out = out.withColumns({"_a1": a1, "_a2": a2}).drop("a1", "a2").withColumnsRenamed({"_a1": "a1", "_a2": "a2"})
    return out.withColumn("b2", F.expr("a1 * xb + b1 - a2 * xb"))


def piecewise(x: Column, coef: Column) -> Column:
    """The line before the break (at it too) or behind it; coef: struct xb, a1, b1, a2, b2."""
    return F.when(x <= coef["xb"], coef["a1"] * x + coef["b1"]).when(x > coef["xb"], coef["a2"] * x + coef["b2"])


def global_trend(rows: DataFrame, keys: list[str], x: str, side: str, y: Column, w: Column, v_min: float, v_max: float, eps: float, side_least: int, bins: int = 10) -> DataFrame:
    """rows with trend and own: the side's two-piece line (own) where a side (sign of the column side) has side_least rows, else that of all rows.

    Without a weighted row among keys trend is null.
    """
    good = rows.where(w > 0)
    fit = lambda r, k: projected_slopes(two_piece(r, k, F.col(x), y, w, bins), v_min, v_max, eps).select(*k, F.struct("xb", "a1", "b1", "a2", "b2").alias("coef"))
    whole = fit(good, keys).withColumnRenamed("coef", "_all")
    sided = good.where(f"{side} <> 0").withColumn("_sign", F.signum(side).cast("int"))
    many = sided.groupBy(*keys, "_sign").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= side_least).drop("_n")
    own = fit(sided.join(many, [*keys, "_sign"]), [*keys, "_sign"]).withColumnRenamed("coef", "_own")
    out = rows.withColumn("_sign", F.signum(side).cast("int")).join(whole, keys, "left").join(own, [*keys, "_sign"], "left")
    return out.withColumn("trend", piecewise(F.col(x), F.coalesce("_own", "_all"))).withColumn("own", F.col("_own").isNotNull()).drop("_own", "_all", "_sign")
