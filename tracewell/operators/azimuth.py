"""Azimuth bins cut at the valleys of a smoothed circular histogram (native expressions only).

Everything that grows with the rows is summed first: values into counts, counts
into bins with their least and greatest value. Valleys are found on one array of
bins a key.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.signal import let, total

TURN = 2 * pi
CELLS = 4096


@dataclass(frozen=True)
class AzimuthKnobs:
    """Widths in bins; prominence as a share of the rows of a key, one row at least."""

    bins: int = 720
    smooth: str = "moving"
    width: int = 15
    sigma: float = 6.0
    prominence: float = 0.02
    apart: int = 20
    rows_a_bin: int = 200
    most_bins: int = 12


def _circular(angle: Column) -> Column:
    return F.pmod(F.radians(angle), F.lit(TURN))


def _origins(counted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, origin: the value behind the widest gap of a key, the first of equal gaps.

    Values meet in cells; the gap behind the last value of a cell ends at the
    next cell's least value. So no task sorts more than a cell.
    """
    cells = counted.withColumn("cell", F.floor(F.col("a") / TURN * CELLS))
    each = Window.partitionBy(*keys, "cell").orderBy("a")
    inside = cells.select(*keys, "cell", "a", F.lead("a").over(each).alias("b")).where("b is not null")
    inside = inside.groupBy(*keys).agg(F.max_by(F.struct("a", "b"), F.struct(F.expr("b - a").alias("gap"), (-F.col("a")).alias("first"))).alias("_g"))
    ends = cells.groupBy(*keys, "cell").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    ring = Window.partitionBy(*keys)
    ends = ends.withColumn("b", F.coalesce(F.lead("lo").over(ring.orderBy("cell")), F.min("lo").over(ring) + TURN))
    between = ends.groupBy(*keys).agg(F.max_by(F.struct(F.col("hi").alias("a"), "b"), F.struct(F.expr("b - hi").alias("gap"), (-F.col("hi")).alias("first"))).alias("_g"))
    both = inside.unionByName(between).groupBy(*keys)
    return both.agg(F.max_by("_g.b", F.struct(F.expr("_g.b - _g.a").alias("gap"), (-F.col("_g.a")).alias("first"))).alias("b")).select(*keys, F.when(F.col("b") >= TURN, F.col("b") - TURN).otherwise(F.col("b")).alias("origin"))


def _kernel(k: AzimuthKnobs) -> list[tuple[int, float]]:
    """(shift, weight) of the circular smoothing."""
    if k.smooth == "moving":
        w = max(1, k.width)
        return [(d, 1.0 / w) for d in range(w // 2 - w + 1, w // 2 + 1)]
    raw = [exp(-0.5 * (min(d, k.bins - d) / k.sigma) ** 2) for d in range(k.bins)]
    return [(d, v / sum(raw)) for d, v in enumerate(raw)]


def smoothed(hist: Column, k: AzimuthKnobs) -> Column:
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in _kernel(k)])
    at = lambda i: total(F.transform(kernel, lambda s: s["w"] * F.get(hist, F.pmod(i - s["d"], F.lit(k.bins)))))
    return F.transform(F.sequence(F.lit(0), F.lit(k.bins - 1)), at)


def valleys(h: Column, least: Column, apart: int, n: int) -> Column:
    """Places of strict minima, ascending: both shoulders least above them, deeper ones first, none within apart of a kept one.

    A shoulder is the value reached from the neighbour by going outward as long
    as values do not rise. Of equally deep minima the first place goes first.
    """
    value = lambda i: F.get(h, F.pmod(i, F.lit(n)))

    def shoulder(i: Column, way: int) -> Column:
        start = F.struct(value(i + way).alias("v"), F.lit(True).alias("go"))

        def step(s: Column, d: Column) -> Column:
            ahead = value(i + d * way)
            on = s["go"] & (ahead <= s["v"])
            return F.struct(F.when(on, ahead).otherwise(s["v"]).alias("v"), on.alias("go"))

        return F.aggregate(F.sequence(F.lit(2), F.lit(n - 1)), start, step, lambda s: s["v"])

    places = F.sequence(F.lit(0), F.lit(n - 1))
    minima = F.filter(places, lambda i: (value(i - 1) > value(i)) & (value(i + 1) > value(i)))
    deep = F.filter(minima, lambda i: F.least(shoulder(i, -1), shoulder(i, 1)) - value(i) >= least)
    order = F.array_sort(F.transform(deep, lambda i: F.struct(value(i).alias("v"), i.alias("i"))))

    def taken(kept: Column, c: Column) -> Column:
        gap = lambda j: F.least(F.pmod(c["i"] - j, F.lit(n)), F.pmod(j - c["i"], F.lit(n)))
        return F.when(F.exists(kept, lambda j: gap(j) <= apart), kept).otherwise(F.concat(kept, F.array(c["i"])))

    return F.array_sort(F.aggregate(order, F.array().cast("array<int>"), taken))


def azimuth_cuts(rows: DataFrame, keys: list[str], angle: Column, k: AzimuthKnobs = AzimuthKnobs()) -> DataFrame:
    """keys, rows, origin (radians), hist, hist_smooth, cuts (bins counted from origin), fallback.

    Without a valley the cuts are quantiles: one for every rows_a_bin rows up to
    most_bins, none where that is one. A quantile between two values in one bin
    lies in that bin; else its neighbours are the greatest and least of theirs.
    Rows without an angle are left out.
    """
    counted = rows.select(*keys, _circular(angle).alias("a")).where("a is not null").groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("c"))
    turned = counted.join(_origins(counted, keys), keys).withColumn("r", F.pmod(F.col("a") - F.col("origin"), F.lit(TURN)))
    bins = turned.groupBy(*keys, "origin", _bin(F.col("r"), k).alias("bin")).agg(F.sum("c").alias("c"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    run = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumn("upto", F.sum("c").over(run))
    per = bins.groupBy(*keys, "origin").agg(F.sum("c").alias("rows"), F.map_from_entries(F.collect_list(F.struct("bin", F.col("c").cast("double")))).alias("m"), F.array_sort(F.collect_list(F.struct("bin", "upto", "lo", "hi"))).alias("t"))
    per = per.withColumn("hist", F.transform(F.sequence(F.lit(0), F.lit(k.bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))))
    per = per.withColumn("hist_smooth", smoothed(F.col("hist"), k))
    per = per.withColumn("found", valleys(F.col("hist_smooth"), F.greatest(F.col("rows") * k.prominence, F.lit(1.0)), k.apart, k.bins))
    parts = F.greatest(F.lit(1), F.least(F.lit(k.most_bins), F.floor(F.col("rows") / k.rows_a_bin))).cast("int")

    def quantile(j: Column) -> Column:
        at = j / (parts + 1) * (F.col("rows") - 1)
        holder = lambda rank: F.get(F.filter("t", lambda b: b["upto"] > rank), F.lit(0))
        a, b = holder(F.floor(at)), holder(F.ceil(at))
        edge = a["hi"] + (at - F.floor(at)) * (b["lo"] - a["hi"])
        return F.when(a["bin"] == b["bin"], a["bin"]).otherwise(_bin(edge, k))

    even = F.when(parts > 1, F.array_sort(F.transform(F.sequence(F.lit(1), parts), quantile))).otherwise(F.array().cast("array<int>"))
    none = F.size("found") == 0
    return per.select(*keys, "rows", "origin", "hist", "hist_smooth", F.when(none, even).otherwise(F.col("found")).alias("cuts"), none.alias("fallback"))


def _bin(r: Column, k: AzimuthKnobs) -> Column:
    return F.pmod(F.floor(r / TURN * k.bins).cast("int"), F.lit(k.bins))


def azimuth_labels(rows: DataFrame, keys: list[str], angle: Column, k: AzimuthKnobs = AzimuthKnobs()) -> DataFrame:
    """rows with azimuth_bin: cuts at or before the row's bin, counted round the circle; null without an angle."""
    cuts = azimuth_cuts(rows, keys, angle, k).select(*keys, F.col("origin").alias("_o"), F.col("cuts").alias("_c"))
    at = _bin(F.pmod(_circular(angle) - F.col("_o"), F.lit(TURN)), k)
    label = let(at, lambda b: F.size(F.filter("_c", lambda c: c <= b)))
    out = rows.join(cuts, keys, "left")
    found = F.when(F.size("_c") == 0, F.lit(0)).otherwise(label % F.size("_c"))
    return out.withColumn("azimuth_bin", F.when(angle.isNotNull(), found)).drop("_o", "_c")
