"""Residual statics: shifts of traces against the median of their neighbours, and robust trends.

Statics run gather by gather in one pass: a gather must fit one task (a spread
of channels does). Trends are native, but for the sampled lines (Arrow batches of
sections); at most one section of rows meets.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.signal import let, total
from tracewell.operators.gathers import spread, trace_windows


def reference(x: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the valid neighbours within k rows (itself left out) and their number."""
    out, count = np.zeros_like(x), np.zeros(len(x), int)
    for i in range(len(x)):
        near = [j for j in range(max(0, i - k), min(len(x), i + k + 1)) if j != i and valid[j]]
        count[i] = len(near)
        if near:
            out[i] = np.median(x[near], axis=0)
    return out, count


def lags(x: np.ndarray, ref: np.ndarray, most: int, penalty: float, refine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best lag (late traces are positive) and its correlation, of differences under a hann taper."""
    a, b = np.diff(x, axis=1), np.diff(ref, axis=1)
    n = a.shape[1]
    a, b = a * np.hanning(n), b * np.hanning(n)
    most = min(most, n - 1)
    steps = np.arange(-most, most + 1)
    c = np.zeros((len(x), len(steps)))
    for j, s in enumerate(steps):
        u = a[:, max(s, 0) : n + min(s, 0)]
        v = b[:, max(-s, 0) : n - max(s, 0)]
        u, v = u - u.mean(1, keepdims=True), v - v.mean(1, keepdims=True)
        size = np.sqrt((u * u).sum(1) * (v * v).sum(1))
        c[:, j] = np.where(size > 1e-12, (u * v).sum(1) / np.maximum(size, 1e-12), 0)
    score = c - penalty * np.abs(steps) / max(most, 1)
    order = np.lexsort((steps, np.abs(steps)))
    tied = score[:, order] >= score.max(1, keepdims=True) - 1e-14
    best = order[tied.argmax(1)]
    rows = np.arange(len(x))
    lag = steps[best].astype(float)
    if refine:
        inner = (best > 0) & (best < len(steps) - 1)
        at = np.clip(best, 1, max(1, len(steps) - 2))
        lo, mid, hi = (score[rows, np.clip(at + d, 0, len(steps) - 1)] for d in (-1, 0, 1))
        bend = lo - 2 * mid + hi
        usable = inner & (np.abs(bend) > 1e-12)
        lag += np.where(usable, np.clip(0.5 * (lo - hi) / np.where(usable, bend, 1), -1, 1), 0)
    return lag, c[rows, best]


def smoothed(shift: np.ndarray, weight: np.ndarray, lam: float) -> np.ndarray:
    """Minimises sum w (s - d)^2 + lam sum (s[i+1] - s[i])^2; zeros without any weight."""
    n = len(shift)
    if n == 0 or not (weight > 0).any():
        return np.zeros(n)
    if n == 1 or lam == 0:
        return np.where(weight > 0, shift, 0.0)
    diag = weight + lam * np.where((np.arange(n) == 0) | (np.arange(n) == n - 1), 1, 2)
    rhs = weight * shift
    c, d = np.zeros(n), np.zeros(n)
    for i in range(n):
        pivot = diag[i] + (lam * c[i - 1] if i else 0)
        c[i] = -lam / pivot if i < n - 1 else 0
        d[i] = (rhs[i] + (lam * d[i - 1] if i else 0)) / pivot
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def moved(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Rows delayed by shift samples, linear, zeros outside."""
    t = np.arange(x.shape[1])
    return np.stack([np.interp(t - s, t, row, left=0.0, right=0.0) for row, s in zip(x, shift, strict=True)]) if len(x) else x


def refine(rows: DataFrame, keys: list[str], order: str, most: int = 8, k: int = 5, rounds: int = 2, c_th: float = 0.5, lam: float = 5.0, penalty: float = 0.0, subsample: bool = True) -> DataFrame:
    """keys, order, delta_pick (later is positive), cmax, valid: rounds of reference, lag, smoothing and shift.

    Flat traces are not valid and keep delta_pick 0.
    """

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        x = np.stack(part["samples"].to_list()).astype(float)
        valid = x.std(1) >= 1e-10
        delta, c = np.zeros(len(x)), np.zeros(len(x))
        for _ in range(rounds):
            ref, near = reference(x, valid, k)
            use = valid & (near > 0) & (ref.std(1) >= 1e-10)
            lag, c = lags(x, ref, most, penalty, subsample)
            lag, c = np.where(use, lag, 0), np.where(use, c, 0)
            weight = np.where(use & (c >= c_th), np.clip((c - c_th) / (1 - c_th), 0, 1), 0) * np.clip(near / (2 * k), 0, 1)
            step = np.where(valid, smoothed(lag, weight, lam), 0)
            x, delta = moved(x, -step), delta + step
        out = part[[*keys, order]].copy()
        out["delta_pick"], out["cmax"], out["valid"] = delta, c, valid
        return out

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, order])
    return rows.select(*keys, order, "samples").groupBy(*keys).applyInPandas(gather, f"{kinds}, delta_pick double, cmax double, valid boolean")


def sections(rank: Column, n: Column, size: int, stride: int) -> Column:
    """Starts 0, stride, ... of the sections that hold a rank."""
    first = F.greatest(F.ceil((rank - size + 1) / stride), F.lit(0)) * stride
    return F.sequence(first.cast("long"), (F.floor(rank / stride) * stride).cast("long"), F.lit(stride).cast("long"))


def robust_trend(rows: DataFrame, keys: list[str], size: int, stride: int, rounds: int = 3, huber: float = 1.345, v_min: float = 300.0, v_max: float = 8000.0) -> DataFrame:
    """keys, rank, trend_t, trend_s, covered: overlapping lines refitted by Huber weights, blended by hann.

    rows hold rank (by offset), n, x, y, valid (0 or 1) and w. Sections of
    fewer than four rows are left out; slopes are held to the speed bounds.
    """
    part = _section_rows(rows, keys, size, stride).withColumn("u", F.transform("r", lambda e: e["v"] * e["p"]))
    for _ in range(rounds):
        part = _refitted(part)
        part = part.withColumn("scale", huber * F.greatest(1.4826 * _middle(F.transform("res", F.abs)), F.lit(1e-6)))
        weigh = lambda e, d: e["v"] * e["p"] * F.when(F.abs(d) <= F.col("scale"), 1.0).otherwise(F.least(F.col("scale") / F.abs(d), F.lit(10.0)))
        part = part.withColumn("u", F.zip_with("r", "res", weigh))
    return _blended(part, keys, lambda e, g: e["v"] * e["p"], v_min, v_max)


def consensus_trend(rows: DataFrame, keys: list[str], size: int, stride: int, seed: str, trials: int = 32, tau: float = 2.0, floor: float = 0.015, rounds: int = 1, v_min: float = 300.0, v_max: float = 6000.0) -> DataFrame:
    """keys, rank, trend_t, trend_s, covered, as robust_trend; a section's line is the one of most inlier weight among sampled pairs.

    Pairs are drawn by weight from hashes of seed, keys, section and trial, so
    they repeat. Inliers lie within tau deviations (median form) of the section's
    times, or floor seconds. The best pair's line (the first of equals) is refitted
    to its inliers. A section without weight, or with no pair of different x, has
    no line and covers nothing.
    """
    part = _section_rows(rows, keys, size, stride)
    label = F.concat_ws(":", F.lit(seed), *map(F.col, keys), "start")
    line = F.arrow_udf(_consensus(trials, tau, floor, rounds, 1 / v_max, 1 / v_min), f"array<struct<rank {rows.schema['rank'].dataType.simpleString()}, c double, t double, s double>>")
    # behind Python Spark no longer knows that a gather is in one task: deal gathers again, not by the number of shuffle partitions
    spark = rows.sparkSession
    out = part.select(*keys, line("r", label).alias("e")).repartition(spread(spark, rows.count(), 150_000), *keys)
    # explode would ask for arrays with rows first, which runs the function twice
    out = out.select(*keys, F.explode_outer("e").alias("e")).where("e is not null")
    return _averaged(out.select(*keys, "e.*"), keys)


def _consensus(trials: int, tau: float, floor: float, rounds: int, least: float, most: float) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """What the sections of an Arrow batch add to their rows: weight c, and c times time and slope; null without a line.

    Sections are rows of arrays as wide as the longest; sums run from the left.
    Nulls and NaN count as in SQL: a null is no inlier and leaves a refit without
    a line, a deviation that is NaN takes every row for an inlier.
    """
    ends = [f":{k}:{side}".encode() for k in range(trials) for side in (1, 2)]

    def add(r: pa.Array, label: pa.Array) -> pa.Array:
        size = r.value_lengths().to_numpy(zero_copy_only=False)
        cells, n, wide = r.flatten(), len(size), int(size.max(initial=1))
        here = np.arange(wide) < size[:, None]
        at = np.where(here, (np.cumsum(size) - size)[:, None] + np.arange(wide), 0)
        x, y, v, p = (cells.field(k).to_numpy(zero_copy_only=False).astype(float)[at] for k in "xyvp")
        no_x, no_y, no_v = (cells.field(k).is_null().to_numpy(zero_copy_only=False)[at] & here for k in "xyv")
        upto = np.cumsum(np.where(here, v * p, 0.0), axis=1)
        tot, weight = upto[:, -1], np.where(here & ~(no_x | no_y | no_v), v * p, 0.0)

        middle = lambda z: np.take_along_axis(np.sort(np.where(here, z, np.nan), axis=1), (size[:, None] - 1) // 2, axis=1)
        deviation = np.where((size - 1) // 2 < size - no_y.sum(axis=1), middle(np.abs(y - middle(y)))[:, 0], 0.0)
        thr = np.maximum(tau * np.maximum(1.4826 * deviation, 1e-6), floor)[:, None]

        def inliers(w: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Weights of the rows in place w where they lie near the lines."""
            far = np.abs((y[:, w, None] - a - b * x[:, w, None]) * v[:, w, None])
            return np.where((far <= thr) | np.isnan(thr), weight[:, w, None], 0.0)

        draws = b"".join([md5(z + e).digest()[:4] for z in map(str.encode, label.to_pylist()) for e in ends])
        drawn = (np.frombuffer(draws, ">u4") / 2.0**32).reshape(n, trials, 2) * tot[:, None, None]
        i, j = (sum((upto[:, w, None] <= drawn[:, :, side]) & here[:, w, None] for w in range(wide)) for side in (0, 1))
        j = np.where(i == j, (j + 1) % size[:, None], j)
        fine = (i < size[:, None]) & (j < size[:, None])
        of = lambda z, k: np.take_along_axis(z, np.where(fine, k, 0), axis=1)
        dx = of(x, j) - of(x, i)
        fine = fine & ~of(no_x | no_y, i) & ~of(no_x | no_y, j) & ~(np.abs(dx) < 1e-6)
        b = (of(y, j) - of(y, i)) / np.where(fine, dx, 1.0)
        a = of(y, i) - b * of(x, i)
        score = sum(inliers(w, a, b) for w in range(wide))
        best = np.argmax(np.where(fine, score, -np.inf), axis=1)[:, None]  # the first of equals
        a, b = np.take_along_axis(a, best, axis=1), np.take_along_axis(b, best, axis=1)

        kept = lambda: np.concatenate([inliers(w, a, b) for w in range(wide)], axis=1)
        total_ = lambda z: np.cumsum(np.where(here, z, 0.0), axis=1)[:, -1:]
        lost = (no_x | no_y | no_v).any(axis=1)[:, None] & (rounds > 0)
        for _ in range(rounds):
            u = kept()
            sw, sx, sy, sxx, sxy = np.maximum(total_(u), 1e-12), total_(u * x), total_(u * y), total_(u * x * x), total_(u * x * y)
            b = (sw * sxy - sx * sy) / np.maximum(sw * sxx - sx * sx, 1e-12)
            a = (sy - b * sx) / sw
        c = np.where(lost, 0.0, (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(wide) / (size[:, None] - 1))) * kept())
        slow = np.where(lost, least, np.fmin(np.maximum(b, least), most))
        made = [pa.array(c[here]), pa.array((c * (a + b * x))[here], mask=(lost | no_x)[here]), pa.array((c * slow)[here])]
        made = pa.StructArray.from_arrays([cells.field("rank"), *made], ["rank", "c", "t", "s"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), made, mask=pa.array(~(fine.any(axis=1) & (tot > 0))))

    def quiet(r: pa.Array, label: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return add(r, label)

    return quiet


def _section_rows(rows: DataFrame, keys: list[str], size: int, stride: int) -> DataFrame:
    """keys, start, r: the rows of every section of four or more, by rank."""
    each = rows.withColumn("start", F.explode(sections(F.col("rank"), F.col("n"), size, stride)))
    return each.groupBy(*keys, "start").agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y", F.col("valid").cast("double").alias("v"), F.col("w").cast("double").alias("p")))).alias("r")).where(F.size("r") >= 4)


def _middle(a: Column) -> Column:
    """The lower median."""
    return let(F.array_sort(a), lambda s: F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")))


def _refitted(part: DataFrame) -> DataFrame:
    """a, b and res of the line by weights u."""
    add = lambda f: total(F.zip_with("r", "u", f))
    part = part.withColumns({"sw": F.greatest(total(F.col("u")), F.lit(1e-12)), "sx": add(lambda e, u: u * e["x"]), "sy": add(lambda e, u: u * e["y"]), "sxx": add(lambda e, u: u * e["x"] * e["x"]), "sxy": add(lambda e, u: u * e["x"] * e["y"])})
    part = part.withColumn("b", F.expr("(sw * sxy - sx * sy) / greatest(sw * sxx - sx * sx, 1e-12D)"))
    part = part.withColumn("a", F.expr("(sy - b * sx) / sw"))
    return part.withColumn("res", let(F.struct("a", "b"), lambda g: F.transform("r", lambda e: (e["y"] - g["a"] - g["b"] * e["x"]) * e["v"])))


def _blended(part: DataFrame, keys: list[str], weight: Callable[[Column, Column], Column], v_min: float, v_max: float) -> DataFrame:
    """keys, rank, trend_t, trend_s, covered: the sections' lines averaged by hann tapers times weight."""
    slow = F.least(F.greatest(F.col("b"), F.lit(1 / v_max)), F.lit(1 / v_min))
    taper = lambda i: 0.5 - 0.5 * F.cos(2 * F.pi() * i / (F.size("r") - 1))
    each = lambda g: F.transform("r", lambda e, i: F.struct(e["rank"].alias("rank"), (g["a"] + g["b"] * e["x"]).alias("t"), (taper(i) * weight(e, g)).alias("w")))
    blend = let(F.struct("a", "b"), each)
    out = part.select(*keys, slow.alias("_s"), F.explode(blend).alias("e"))
    return _averaged(out.select(*keys, "e.rank", F.col("e.w").alias("c"), F.expr("e.w * e.t").alias("t"), F.expr("e.w * _s").alias("s")), keys)


def _averaged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rank, trend_t, trend_s, covered from the weights c and weighted t and s that sections give a row."""
    out = rows.groupBy(*keys, "rank").agg(*[F.sum(k).alias(k) for k in ("c", "t", "s")])
    return out.select(*keys, "rank", *[(F.col(k) / F.greatest(F.col("c"), F.lit(1e-6))).alias(f"trend_{k}") for k in ("t", "s")], (F.col("c") > 0).alias("covered"))


def fused(logit: Column, prior: Column, gate: Column, alpha: float = 1.0, clip: float = 30.0, eps: float = 1e-12) -> Column:
    """Clipped logit + alpha log(prior) where gate holds, the clipped logit elsewhere."""
    hold = lambda v: F.least(F.greatest(v, F.lit(-clip)), F.lit(clip))
    plain = F.transform(logit, lambda v: hold(F.when(F.isnan(v), 0.0).otherwise(v)))
    return F.when(gate, F.zip_with(plain, prior, lambda v, p: hold(v + alpha * F.log(F.greatest(p, F.lit(eps)))))).otherwise(plain)


def striped(rows: DataFrame, keys: list[str], band: int, score) -> DataFrame:
    """keys, rank, samples: every band of rows hidden (zeros) once, scored, and kept where it was hidden.

    score maps an array of rows x samples to one of the same shape. A tile of
    a gather meets in one task, which copies it for one band after the other.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        x = np.stack(part["samples"].to_list()).astype(float)
        of, kept = (part["rank"] // band).to_numpy(), np.zeros_like(x)
        for b in np.unique(of):
            hidden = of == b
            z = x.copy()
            z[hidden] = 0
            y = score(z)
            if y.shape != x.shape:
                raise ValueError("the scoring function must keep the shape")
            kept[hidden] = y[hidden]
        out = part[[*keys, "rank"]].copy()
        out["samples"] = list(kept)
        return out

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, "rank"])
    return rows.select(*keys, "rank", "samples").groupBy(*keys).applyInPandas(run, f"{kinds}, samples array<double>")


def chunked(rows: DataFrame, keys: list[str], chunk: int, overlap: int, band: int, score) -> DataFrame:
    """keys, rank, t, y: striped scores of overlapping chunks of rows, blended by hann on inner edges.

    The last chunk is pulled back to the end. Rows hold rank, n and samples.
    """
    cut = trace_windows(rows, keys, chunk, chunk - overlap)
    cut = cut.withColumn("_m", F.least(F.col("n"), F.lit(chunk).cast("long")))
    done = striped(cut.select(*keys, "start", F.col("row").alias("rank"), F.col("_m").alias("n"), "samples"), [*keys, "start"], band, score)
    size = cut.select(*keys, "start", F.col("row").alias("rank"), "n", "_m")
    rise = F.greatest(0.5 - 0.5 * F.cos(2 * F.pi() * F.col("rank") / F.greatest(F.col("_m") - 1, F.lit(1))), F.lit(1e-3))
    top = (F.col("start") > 0) & (F.col("rank") < overlap)
    bottom = (F.col("start") + F.col("_m") < F.col("n")) & (F.col("rank") >= F.col("_m") - overlap)
    weight = F.when(top, rise).otherwise(1.0) * F.when(bottom, rise).otherwise(1.0)
    met = done.join(size, [*keys, "start", "rank"]).select(*keys, (F.col("start") + F.col("rank")).alias("rank"), weight.alias("_w"), F.posexplode("samples").alias("t", "_y"))
    return met.groupBy(*keys, "rank", "t").agg((F.sum(F.expr("_w * _y")) / F.sum("_w")).alias("y"))
