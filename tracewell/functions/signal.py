"""Per-trace functions over array<double> columns (native expressions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also inside lambdas over arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def std_pop(a: Column) -> Column:
    return let(mean(a), lambda m: F.sqrt(total(F.transform(a, lambda v: (v - m) * (v - m))) / F.size(a)))


def standardize(a: Column, eps: float = 1e-6) -> Column:
    return let(F.struct(mean(a).alias("m"), std_pop(a).alias("s")), lambda k: F.transform(a, lambda v: (v - k["m"]) / (k["s"] + eps)))


def softmax(a: Column, scale: float = 1.0) -> Column:
    raised = let(F.array_max(a), lambda top: F.transform(a, lambda v: F.exp(F.lit(scale) * (v - top))))
    return let(raised, lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))


def soft_clip(a: Column, c: float) -> Column:
    return F.transform(a, lambda v: F.lit(c) * F.tanh(v / c))


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def entropy_confidence(p: Column, floor: float = 0.0, power: float = 1.0) -> Column:
    h = F.aggregate(p, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.log(v)).otherwise(0.0))
    return F.pow(F.greatest(F.lit(floor), 1 - h / F.log(F.size(p).cast("double"))), F.lit(power))


def aligned(a: Column, at: Column, pre: int, post: int, fill: float = 0.0) -> Column:
    """Samples at - pre .. at + post - 1, fill outside the trace."""
    steps = F.sequence(F.lit(-pre), F.lit(post - 1))
    return F.transform(steps, lambda k: F.coalesce(F.when(at + k >= 0, F.get(a, (at + k).cast("int"))), F.lit(fill)))


def shifted(a: Column, shift: Column, fill: float = 0.0) -> Column:
    """y[t] = a[t - shift] by linear interpolation."""

    def at(t: Column) -> Column:
        p = t - shift
        i = F.floor(p).cast("int")
        w = p - i
        lo = F.when(i >= 0, F.get(a, i))
        hi = F.when(i + 1 >= 0, F.get(a, i + 1))
        return F.when(w == 0, lo).otherwise(lo * (1 - w) + hi * w)

    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda t: F.coalesce(at(t), F.lit(fill)))


def gaussian(center: Column, width: int, sigma: float) -> Column:
    """Row of height 1 about the centre; zeros where the centre is no pick."""
    steps = F.sequence(F.lit(0), F.lit(width - 1))
    return F.transform(steps, lambda t: F.when(center > 0, F.exp(-0.5 * ((t - center) / sigma) ** 2)).otherwise(F.lit(0.0)))


def hysteresis(a: Column, on: float, off: float, min_on: int, refractory: int) -> Column:
    """Starts of runs over `on` of min_on samples, until `off`, none within refractory of the last."""
    zero = F.struct(F.lit(0).alias("t"), F.lit(0).alias("run"), F.lit(False).alias("active"), F.lit(-(10**6)).alias("last"), F.expr("cast(array() as array<int>)").alias("hits"))

    def step(s: Column, v: Column) -> Column:
        run = F.when(v > on, s["run"] + 1).otherwise(0)
        start = s["t"] - run + 1
        fire = ~s["active"] & (run >= min_on) & (start - s["last"] >= refractory)
        active = F.when(fire, True).when(v <= off, False).otherwise(s["active"])
        return F.struct((s["t"] + 1).alias("t"), run.alias("run"), active.alias("active"), F.when(fire, start).otherwise(s["last"]).alias("last"), F.when(fire, F.concat(s["hits"], F.array(start))).otherwise(s["hits"]).alias("hits"))

    return F.aggregate(a, zero, step, lambda s: s["hits"])
