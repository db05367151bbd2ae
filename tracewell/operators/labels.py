"""Label rows, masks, channels and mixes over traces of a gather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.signal import total
from tracewell.operators.gathers import uniform


def pulses(picks: Column, width: int, sigma: float) -> Column:
    """1 - product over the picks of (1 - pulse of height 1); zeros without picks."""
    miss = lambda t: F.aggregate(picks, F.lit(1.0), lambda s, mu: s * (1 - F.exp(-0.5 * F.pow((t - mu) / sigma, 2))))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda t: 1 - miss(t))


def phase_map(rows: DataFrame, p_picks: str, s_picks: str, width: int, sigma: float) -> DataFrame:
    """Adds arrays p, s, noise that sum to 1 at every sample, and label_valid (some pick)."""
    out = rows.withColumn("_p", pulses(F.col(p_picks), width, sigma)).withColumn("_s", pulses(F.col(s_picks), width, sigma))
    out = out.withColumn("_n", F.zip_with("_p", "_s", lambda p, s: F.greatest(1 - p - s, F.lit(0.0))))
    whole = F.zip_with(F.zip_with("_p", "_s", lambda p, s: p + s), "_n", lambda a, n: a + n)
    out = out.withColumn("_d", whole)
    share = lambda c: F.zip_with(c, "_d", lambda v, d: v / d)
    out = out.withColumns({"p": share("_p"), "s": share("_s"), "noise": share("_n"), "label_valid": (F.size(p_picks) > 0) | (F.size(s_picks) > 0)})
    return out.drop("_p", "_s", "_n", "_d")


def trace_mask(rows: DataFrame, keys: list[str], ratio: float, width: int, seed: str) -> DataFrame:
    """Adds masked: bands of width rows around ceil(ratio * n / width) rows picked by hash.

    rows hold rank and n (rows of the gather). Bands keep their width at the
    edges. Nothing is masked where ratio * n rounds to 0, all where it reaches n.
    """
    target = F.rint(F.lit(ratio) * F.col("n"))
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(seed), "rank")), "rank")
    centres = F.least(F.greatest(F.ceil(target / width), F.lit(1)), F.col("n"))
    chosen = (F.row_number().over(order) <= centres) & (target > 0)
    for k in keys:  # rows without a key are of no gather
        chosen = chosen & F.col(k).isNotNull()
    half, last, rank = width // 2, F.col("n") - width, F.col("rank")
    gather = Window.partitionBy(*keys).orderBy("rank")
    among = lambda c, frame: F.coalesce(F.max(c).over(frame), F.lit(False))
    over = among(F.col("_c"), gather.rangeBetween(half + 1 - width, half))
    every = gather.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = (rank < width) & among(F.col("_c") & (rank <= half), every)
    tail = (rank >= last) & among(F.col("_c") & (rank >= last + half), every)
    whole = (target >= F.col("n")) | ((F.lit(width) >= F.col("n")) & (target > 0))
    return rows.withColumn("_c", chosen).withColumn("masked", whole | over | head | tail).drop("_c")


def checker_mask(rows: DataFrame, keys: list[str], width: int, block: tuple[int, int], cell: tuple[int, int], jitter: tuple[int, int], keep: float, seed: str) -> DataFrame:
    """Adds mask (array of booleans over width samples): one moved block per kept cell.

    rows hold rank and n. Cells and their moves come from hashes of the gather
    and the cell; blocks are kept inside the gather and the trace.
    """
    gathers = rows.select(*keys, "n").distinct()
    cells = gathers.withColumn("gh", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / cell[0]))))
    cells = cells.withColumn("gt", F.explode(F.sequence(F.lit(0), F.lit((width + cell[1] - 1) // cell[1]))))
    draw = lambda k: uniform(F.lit(f"{seed}{k}"), *[F.col(c) for c in keys], F.col("gh"), F.col("gt"))
    move = lambda k, j: F.floor(draw(k) * (2 * j + 1)).cast("long") - j
    h0 = F.greatest(F.least(F.col("gh") * cell[0] + move("h", jitter[0]), F.col("n") - block[0]), F.lit(0))
    t0 = F.greatest(F.least(F.col("gt") * cell[1] + move("t", jitter[1]), F.lit(width - block[1])), F.lit(0))
    spans = cells.where(draw("k") <= keep).select(*keys, F.explode(F.sequence(h0, h0 + block[0] - 1)).alias("rank"), t0.alias("t0"))
    spans = spans.groupBy(*keys, "rank").agg(F.collect_set("t0").alias("_t"))
    inside = lambda t: F.exists("_t", lambda s: (t >= s) & (t < s + block[1]))
    mask = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda t: F.coalesce(inside(t), F.lit(False)))
    return rows.join(spans, [*keys, "rank"], "left").withColumn("mask", mask).drop("_t")


def normal(seed: str, *cols: Column) -> Column:
    """A replayable standard normal number from two hashes."""
    u, v = uniform(F.lit(f"{seed}a"), *cols), uniform(F.lit(f"{seed}b"), *cols)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(2.0**-32)))) * F.cos(2 * F.pi() * v)


def with_noise(samples: Column, mask: Column, key: Column, std: float, seed: str, add: bool = False) -> Column:
    """Masked samples replaced by (or, with add, moved by) normal noise."""
    marked = F.transform(samples, lambda x, t: F.struct(x.alias("x"), t.alias("t")))
    return F.zip_with(marked, mask, lambda e, m: F.when(m, F.when(F.lit(add), e["x"]).otherwise(0.0) + std * normal(seed, key, e["t"])).otherwise(e["x"]))


def centre_window(samples: Column, centre: Column, half: int, up: int) -> Column:
    """2 * half samples around the rounded centre, up times as dense by linear steps; zeros outside."""
    n = 2 * half
    start = F.rint(centre).cast("int") - half
    ok = centre.isNotNull() & ~F.isnan(centre) & (centre > 0)
    at = lambda k: F.when(ok & (start + k >= 0), F.coalesce(F.get(samples, start + k), F.lit(0.0))).otherwise(0.0)

    def value(q: Column) -> Column:
        k = F.floor(q / up).cast("int")
        w = q / up - k
        return F.when(k < n - 1, at(k) * (1 - w) + at(k + 1) * w).when((k == n - 1) & (w == 0), at(k)).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit(n * up - 1)), value)


def offset_channel(keys: list[str], offset: str, valid: Column, eps: float = 1e-6) -> Column:
    """z-score of the offset over valid traces of the gather; 0 where invalid."""
    w = Window.partitionBy(*keys)
    of = F.when(valid, F.col(offset))
    return F.when(valid, (of - F.avg(of).over(w)) / (F.stddev_pop(of).over(w) + eps)).otherwise(0.0)


def rms(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda v: v * v)) / F.size(a))


def mixed(signal: Column, noise: Column, snr_db: Column) -> Column:
    """signal + gain * noise at the wanted ratio; silent noise adds nothing."""
    gain = rms(signal) / rms(noise) * F.pow(F.lit(10.0), -snr_db / 20)
    safe = F.when(rms(noise) > 0, gain).otherwise(0.0)
    return F.zip_with(signal, F.transform(noise, lambda v: v * safe), lambda a, b: a + b)


def stretched(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """keys, rank, samples: rows resampled across the gather about its centre, edges held.

    rows hold rank, n and samples; each view row meets its two source rows.
    """
    centre = (F.col("n") - 1) * 0.5
    at = F.greatest(F.least(centre + (F.col("rank") - centre) / factor, F.col("n") - 1.0), F.lit(0.0))
    low = F.floor(at).cast("long")
    want = rows.select(*keys, "rank", low.alias("a"), F.least(low + 1, F.col("n") - 1).alias("b"), (at - low).alias("w"))
    first = rows.select(*keys, F.col("rank").alias("a"), F.col("samples").alias("_x"))
    second = rows.select(*keys, F.col("rank").alias("b"), F.col("samples").alias("_y"))
    met = want.join(first, [*keys, "a"]).join(second, [*keys, "b"])
    blend = F.zip_with(F.transform("_x", lambda v: v * (1 - F.col("w"))), F.transform("_y", lambda v: v * F.col("w")), lambda x, y: x + y)
    return met.select(*keys, "rank", blend.alias("samples"))
