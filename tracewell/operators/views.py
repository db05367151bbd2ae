"""Views of gathers: transforms in order and what they did, so that picks, offsets and time follow.

A view of a gather is a struct of hflip, factor_h (stretch across traces about the
centre), factor (stretch in time) and start (samples cut off in front); every row
has its own tshift besides. Rows hold rank, n (rows of the gather) and samples.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.signal import shifted
from tracewell.operators import labels, sections

Op = Callable[[DataFrame, list[str]], DataFrame]


def _noted(**fields: Column) -> Column:
    return reduce(lambda v, f: v.withField(*f), fields.items(), F.col("view"))


def flip(when: Column) -> Op:
    """Rows in reverse order where when holds (alike for all rows of a gather)."""
    turned = F.when(when, F.col("n") - 1 - F.col("rank")).otherwise(F.col("rank"))
    return lambda rows, keys: rows.withColumns({"view": _noted(hflip=when), "rank": turned})


def stretch_rows(factor: Column) -> Op:
    """Rows resampled across the gather, edges held."""

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.withColumn("view", _noted(factor_h=factor.cast("double")))
        return rows.drop("samples").join(labels.stretched(rows, keys, F.col("view.factor_h")), [*keys, "rank"])

    return work


def stretch_time(factors: list[float], choice: Column) -> Op:
    """Samples resampled by the factor at place choice (from 0) of a fixed list."""

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        pick = lambda of: reduce(lambda c, i: c.when(choice == i, of(factors[i])), range(1, len(factors)), F.when(choice == 0, of(factors[0])))
        return rows.withColumns({"view": _noted(factor=pick(lambda f: F.lit(float(f)))), "samples": pick(lambda f: sections.time_stretched(F.col("samples"), f))})

    return work


def cut(start: Column, width: int) -> Op:
    """width samples from start, or from as near to it as the trace allows; zeros behind a shorter trace."""
    first = F.least(start, F.greatest(F.size("samples") - width, F.lit(0))).cast("int")
    return lambda rows, keys: rows.withColumns({"view": _noted(start=first), "samples": sections.crop_or_pad(F.col("samples"), width, first)})


def composed(rows: DataFrame, keys: list[str], ops: list[Op], shift: Column | None = None) -> DataFrame:
    """rows after ops in order, with their view and tshift; shift (samples, by view row) comes last. An op done twice is noted once: the last."""
    plain = F.struct(F.lit(False).alias("hflip"), F.lit(1.0).alias("factor_h"), F.lit(1.0).alias("factor"), F.lit(0).alias("start"))
    rows = reduce(lambda r, op: op(r, keys), ops, rows.withColumn("view", plain))
    if shift is None:
        return rows.withColumn("tshift", F.lit(0).cast("long"))
    return rows.withColumn("tshift", shift.cast("long")).withColumn("samples", shifted(F.col("samples"), F.col("tshift")))


def source_row(rank: Column, n: Column, view: Column) -> dict[str, Column]:
    """near, low, high: the rows of the gather that a view row shows; share: how far it lies from low to high."""
    end = n - 1
    at = end * 0.5 + (rank - end * 0.5) / view["factor_h"]
    held = F.least(F.greatest(at, F.lit(0.0)), end.cast("double"))
    clip = lambda j: F.least(F.greatest(j, F.lit(0)), end).cast("long")
    turned = lambda j: F.when(view["hflip"], end - clip(j)).otherwise(clip(j))
    return {"near": turned(F.floor(at + 0.5)), "low": turned(F.floor(held)), "high": turned(F.floor(held) + 1), "share": held - F.floor(held)}


def projected(rows: DataFrame, views: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, row, fb_view, offset_view: raw rows (rank, fb, offset_m) seen in views (rank, n, view, tshift).

    A view row shows the nearest raw row's pick, -1 if there is none or it falls
    outside 1 .. width - 1, and the offset between the two raw rows around it. These
    are neighbours, and the nearest is one of them: raw rows bring both neighbours
    along, so a view row is joined once.
    """
    at = source_row(F.col("rank"), F.col("n"), F.col("view"))
    seen = views.select(*keys, F.col("rank").alias("row"), "view", "tshift", *[c.alias(f"_{k}") for k, c in at.items()])
    own, w = F.struct("fb", "offset_m"), Window.partitionBy(*keys).orderBy("rank")
    raw = rows.select(*keys, F.col("rank").alias("_low"), own.alias("_own"), F.lag(own).over(w).alias("_before"), F.lead(own).over(w).alias("_after"))
    met = seen.join(raw, [*keys, "_low"])
    of = lambda k: F.when(F.col(k) == F.col("_low"), F.col("_own")).when(F.col(k) < F.col("_low"), F.col("_before")).otherwise(F.col("_after"))
    out = met.select(*keys, "row", "view", "tshift", "_share", of("_near")["fb"].alias("_fb"), F.col("_own.offset_m").alias("_lo"), of("_high")["offset_m"].alias("_hi"))
    fb = F.rint(F.col("_fb") * F.col("view.factor")).cast("long") - F.col("view.start") + F.col("tshift")
    inside = (F.col("_fb") > 0) & (fb > 0) & (fb < width)
    return out.select(*keys, "row", F.when(inside, fb).otherwise(-1).cast("long").alias("fb_view"), ((1 - F.col("_share")) * F.col("_lo") + F.col("_share") * F.col("_hi")).alias("offset_view"))


def raw_pick(pick: Column, view: Column, tshift: Column) -> Column:
    """A pick made in the view as a sample of the raw trace; 0 for none."""
    return F.when(pick > 0, F.rint((pick - tshift + view["start"]) / view["factor"])).otherwise(0).cast("long")


def times(view: Column, width: int, t0: float, dt: float) -> Column:
    """The time of every sample of the view."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: t0 + (j + view["start"]) * (dt / view["factor"]))
