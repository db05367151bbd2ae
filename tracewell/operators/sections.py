"""Sections of traces: common lengths, shared scaling, resampling, scoring by a user function, error reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.signal import let, mean, softmax, std_pop, total


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def pad_right(a: Column, width: Column) -> Column:
    """Zeros behind a trace up to a common width."""
    return F.concat(a, zeros(F.greatest(width - F.size(a), F.lit(0))))


def crop_or_pad(a: Column, length: int, start: Column | None = None) -> Column:
    """length samples: the middle ones of a longer trace (or those from start), zeros behind a shorter one."""
    spare = F.greatest(F.size(a) - length, F.lit(0))
    first = F.floor(spare / 2) if start is None else F.least(start, spare)
    return pad_right(F.slice(a, first.cast("int") + 1, F.lit(length)), F.lit(length))


def stacked(*channels: Column) -> Column:
    """Channels of one trace as an array of arrays; unequal lengths are an error."""
    same = [F.size(c) == F.size(channels[0]) for c in channels]
    alike = same[0]
    for s in same[1:]:
        alike = alike & s
    return F.when(alike, F.array(*channels)).otherwise(F.raise_error(F.lit("channels differ in length")).cast(T.ArrayType(T.ArrayType(T.DoubleType()))))


def pair_standardized(x: Column, y: Column, eps: float = 1e-6) -> Column:
    """struct(x, y, mean, std): both scaled by the mean and deviation of the input x."""
    scaled = lambda a, k: F.transform(a, lambda v: (v - k["m"]) / (k["s"] + eps))
    return let(F.struct(mean(x).alias("m"), std_pop(x).alias("s")), lambda k: F.struct(scaled(x, k).alias("x"), scaled(y, k).alias("y"), k["m"].alias("mean"), k["s"].alias("std")))


def unscaled(y: Column, m: Column, s: Column, eps: float = 1e-6) -> Column:
    """A prediction back in the units of the input."""
    return F.transform(y, lambda v: v * (s + eps) + m)


def with_residual(x: Column, predicted: Column) -> Column:
    """Input plus a predicted residual."""
    return F.zip_with(x, predicted, lambda a, b: a + b)


def resampling(factor: float, most: int = 128) -> tuple[int, int, list[float]]:
    """up, down and the low-pass taps of a stretch by the nearest fraction with a denominator of most at the most."""
    from fractions import Fraction

    f = Fraction(factor).limit_denominator(most)
    up, down = f.numerator // gcd(f.numerator, f.denominator), f.denominator
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    return up, down, (taps / taps.sum() * up).tolist()


def time_stretched(a: Column, factor: float) -> Column:
    """Polyphase resampling of a trace to ceil(size * factor) samples (windowed sinc)."""
    up, down, taps = resampling(factor)
    h, half = F.array(*map(F.lit, taps)), len(taps) // 2
    size = F.size(a)
    n_out = F.ceil(size * up / down).cast("int")

    def sample(n: Column) -> Column:
        at = n * down
        lo = F.greatest(F.ceil((at - half) / up), F.lit(0)).cast("int")
        hi = F.least(F.floor((at + half) / up), size - 1).cast("int")
        each = F.transform(F.sequence(lo, hi), lambda k: F.get(a, k) * F.get(h, at - k * up + half))
        return F.when(lo <= hi, total(each)).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), n_out - 1), sample)


def padded_section(rows: DataFrame, keys: list[str], rank: str, samples: str, tile: tuple[int, int]) -> DataFrame:
    """Sections smaller than a tile filled up with zeros: traces added behind (padding true), samples to the right."""
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_h"), F.max(F.size(samples)).alias("_w"))
    wide = rows.join(size, keys).withColumn(samples, pad_right(F.col(samples), F.greatest(F.col("_w"), F.lit(tile[1])))).withColumn("padding", F.lit(False))
    more = size.where(F.col("_h") < tile[0]).withColumn(rank, F.explode(F.sequence(F.col("_h"), F.lit(tile[0] - 1).cast("long"))))
    more = more.withColumn(samples, zeros(F.greatest(F.col("_w"), F.lit(tile[1])))).withColumn("padding", F.lit(True))
    return wide.unionByName(more, allowMissingColumns=True).drop("_h")


def cropped_section(rows: DataFrame, samples: str) -> DataFrame:
    """What padded_section added, taken away again."""
    return rows.where("not padding").withColumn(samples, F.slice(samples, F.lit(1), F.col("_w"))).drop("padding", "_w")


def score_windows(rows: DataFrame, samples: str, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rows with a column score (array<double>): score is given (n, width) blocks of equally long traces, an Arrow batch at most."""
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.ArrayType(T.DoubleType()))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(b.schema.get_field_index(samples)).to_pylist()
            out: list = [None] * len(given)
            widths = np.array([-1 if x is None else len(x) for x in given])
            for w in np.unique(widths[widths >= 0]).tolist():
                at = np.flatnonzero(widths == w)
                for k, y in zip(at.tolist(), score(np.array([given[i] for i in at.tolist()], float).reshape(-1, w)), strict=True):
                    out[k] = y
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=names)

    return rows.mapInArrow(run, schema)


def score_gathers(rows: DataFrame, keys: list[str], rank: str, samples: str, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys, trace_idx, score: score is given a gather (traces by rank, samples) and returns as many; one gather meets in a task.

    A result of another shape is an error. Traces of rows that got no score, for
    a gather without samples, are found by a left_anti join on trace_idx.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], rows.schema["trace_idx"], T.StructField("score", T.ArrayType(T.DoubleType()))])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([rank, "trace_idx"])
        x = np.stack(g[samples].to_list()).astype(float)
        y = np.asarray(score(x))
        if y.shape != x.shape:
            raise ValueError(f"a gather of {x.shape} was scored as {y.shape}")
        return g[[*keys, "trace_idx"]].assign(score=list(y))

    return rows.select(*keys, "trace_idx", rank, samples).groupBy(*keys).applyInPandas(run, schema)


def section_probability(rows: DataFrame, keys: list[str], rank: str, samples: str, tile: tuple[int, int], score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """keys, trace_idx, prob: traces standardised, sections padded to a tile, scored, cropped, softmax along time."""
    from tracewell.functions.signal import standardize

    ready = padded_section(rows.select(*keys, "trace_idx", rank, standardize(F.col(samples)).alias("samples")), keys, rank, "samples", tile)
    ready = ready.withColumn("trace_idx", F.coalesce("trace_idx", -1 - F.col(rank)))
    found = score_gathers(ready, keys, rank, "samples", score).withColumnRenamed("score", "samples")
    back = cropped_section(found.join(ready.select(*keys, "trace_idx", "padding", "_w"), [*keys, "trace_idx"]), "samples")
    return back.select(*keys, "trace_idx", softmax(F.col("samples")).alias("prob"))


def log_softmax(a: Column, tau: float = 1.0) -> Column:
    scaled = F.transform(a, lambda v: v / tau)
    return let(scaled, lambda s: let(F.array_max(s), lambda top: let(F.log(total(F.transform(s, lambda v: F.exp(v - top)))) + top, lambda z: F.transform(s, lambda v: v - z))))


def break_divergence(target: Column, logits: Column, tau: float = 1.0, floor: float = 1.1920928955078125e-07) -> Column:
    """Divergence of softmax(logits / tau) from a target made a distribution, of one trace."""
    q = let(F.transform(target, lambda v: F.greatest(v, F.lit(0.0))), lambda t: let(F.greatest(total(t), F.lit(floor)), lambda s: F.transform(t, lambda v: v / s)))
    return total(F.zip_with(q, log_softmax(logits, tau), lambda p, lp: p * (F.log(F.greatest(p, F.lit(floor))) - lp)))


def prior_cross_entropy(prior: Column, logits: Column, tau: float = 1.0) -> Column:
    """Cross entropy of softmax(logits / tau) under a prior, of one trace."""
    return -total(F.zip_with(prior, log_softmax(logits, tau), lambda p, lp: p * lp))


def weighted_report(rows: DataFrame, keys: list[str], parts: list[tuple[str, Column, Column, float]]) -> DataFrame:
    """keys, one mean a part (name, error, rows in scope, weight; 0 without any row) and total, their weighted sum."""
    means = [F.coalesce(F.avg(F.when(scope, error)), F.lit(0.0)).alias(name) for name, error, scope, _ in parts]
    out = rows.groupBy(*keys).agg(*means)
    sum_ = F.lit(0.0)
    for name, _, _, weight in parts:
        sum_ = sum_ + F.col(name) * weight
    return out.withColumn("total", sum_)


def robust_scale(a: Column, at: Column, half: int, eps: float = 1e-8) -> Column:
    """Median and median absolute deviation (times 1.4826) of the samples within half of a place."""
    part = F.slice(a, F.greatest(at - half, F.lit(0)).cast("int") + 1, (F.least(at + half, F.size(a) - 1) - F.greatest(at - half, F.lit(0)) + 1).cast("int"))
    mid = lambda s: let(F.array_sort(s), lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2)
    return let(part, lambda p: let(mid(p), lambda m: F.struct(m.alias("m"), (mid(F.transform(p, lambda v: F.abs(v - m))) * 1.4826 + eps).alias("s"))))


def robust_agc(a: Column, half: int, hop: int, gamma: float = 1.0) -> Column:
    """Gain control by robust scales at anchors every hop samples (and at the last), interpolated between them."""
    last = F.size(a) - 1
    anchors = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(hop)), F.array(last)))

    def body(k: Column) -> Column:
        def one(v: Column, t: Column) -> Column:
            i = F.floor(t / hop).cast("int")
            lo, hi = F.get(k, i), F.coalesce(F.get(k, i + 1), F.get(k, i))
            gap = F.greatest(hi["at"] - lo["at"], F.lit(1))
            w = (t - lo["at"]) / gap
            m, s = lo["m"] * (1 - w) + hi["m"] * w, lo["s"] * (1 - w) + hi["s"] * w
            return (v - m) / F.pow(s, F.lit(gamma))

        return F.transform(a, one)

    return let(F.transform(anchors, lambda t: let(robust_scale(a, t, half), lambda r: F.struct(t.alias("at"), r["m"].alias("m"), r["s"].alias("s")))), body)

