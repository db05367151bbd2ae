"""Draws that repeat: overrides of sampling, accepted draws under a budget, background starts, noise windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.gathers import uniform

KEYS = ("ffid", "chno", "cmp")
OVERRIDE = "struct<primary_keys: array<string>, primary_ranges: map<string, array<array<bigint>>>, secondary_key_fixed: boolean>"


def overrides(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(read, rejected): JSON overrides of a manifest as struct override, and the rows that break its rules, with a reason."""
    read = rows.withColumn("override", F.from_json(text, OVERRIDE, {"mode": "PERMISSIVE"}))
    keys, ranges = F.col("override.primary_keys"), F.col("override.primary_ranges")
    known = lambda k: k.isin(*KEYS)
    bad_range = F.exists(F.flatten(F.map_values(ranges)), lambda r: (F.size(r) != 2) | (F.get(r, F.lit(0)) > F.get(r, F.lit(1))))
    reason = (
        F.when(F.col(text).isNull(), F.lit(None).cast("string"))
        .when(F.try_parse_json(text).isNull() | F.col("override").isNull(), "json")
        .when(keys.isNotNull() & ((F.size(keys) == 0) | F.exists(keys, lambda k: ~known(k))), "primary_keys")
        .when(F.exists(F.map_keys(ranges), lambda k: ~known(k)), "range_key")
        .when(bad_range, "range")
    )
    judged = read.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").drop("override")


def accepted(draws: DataFrame, keys: list[str], order: list[Column], ok: Column, wanted: int, budget: int) -> DataFrame:
    """Of the first budget draws of each key the first wanted accepted ones: draw (place among all), n (among accepted)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    tried = draws.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= budget).withColumn("_ok", ok.cast("int"))
    tried = tried.withColumn("n", F.sum("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return tried.where((F.col("_ok") == 1) & (F.col("n") <= wanted)).drop("_ok")


def draw_counts(draws: DataFrame, keys: list[str], order: list[Column], reason: Column, wanted: int, budget: int, ok: str = "ok") -> DataFrame:
    """keys, reason, n: what became of the draws up to the last one that was needed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    tried = draws.withColumn("_r", reason).withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= budget)
    had = F.coalesce(F.sum((F.col("_r") == ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tried.withColumn("_had", had).where(F.col("_had") < wanted).groupBy(*keys, F.col("_r").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def subset_draws(traces: DataFrame, draws: DataFrame, files: list[str], draw: str, weights: dict[str, float], height: int, seed: str, fixed: bool = False) -> DataFrame:
    """files, draw, key_name, key, secondary, row, trace_idx, pad: height neighbouring traces of a gather for every draw of a file.

    traces hold ffid, chno, cmp, offset_m, trace_idx. The kind of gather comes by
    weights (those without weight never; all weigh 1 where none has any), the gather
    evenly among the file's, the order (secondary) evenly among the other index and
    the offset, or with fixed the other index (offset for cmp), the first row evenly.
    Gathers of fewer traces are taken whole, pad counts what is missing. All numbers
    are hashes of seed, file and draw. A draw meets the traces of its gather only.
    """
    held = {k: w for k, w in weights.items() if w > 0} or dict.fromkeys(weights, 1.0)
    u = lambda step: uniform(F.lit(f"{seed}{step}"), *[F.col(c) for c in files], F.col(draw))
    place, reach, name = u("k") * sum(held.values()), 0.0, F.lit(list(held)[-1])
    bounds = []
    for k, w in held.items():
        reach += w
        bounds.append((k, reach))
    for k, b in reversed(bounds[:-1]):
        name = F.when(place < b, k).otherwise(name)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("long").alias("key")) for k in held]))
    rows = traces.select(*files, "trace_idx", "ffid", "chno", "offset_m", each.alias("_e")).select("*", "_e.*").drop("_e").where("key is not null")
    kinds = rows.select(*files, "key_name", "key").distinct()
    kind = Window.partitionBy(*files, "key_name")
    kinds = kinds.withColumn("_k", F.row_number().over(kind.orderBy("key")) - 1).withColumn("_n", F.count(F.lit(1)).over(kind))
    counts = kinds.select(*files, "key_name", "_n").distinct()
    drawn = draws.withColumn("key_name", name).join(counts, [*files, "key_name"]).withColumn("_k", F.floor(u("g") * F.col("_n")).cast("int"))
    drawn = drawn.join(kinds.drop("_n"), [*files, "key_name", "_k"]).drop("_k", "_n")
    other = F.when(F.col("key_name") == "ffid", "chno").when(F.col("key_name") == "chno", "ffid").otherwise("offset")
    drawn = drawn.withColumn("secondary", other if fixed else F.when(u("s") < 0.5, other).otherwise("offset")).withColumn("_u", u("r"))
    met = drawn.join(rows, [*files, "key_name", "key"])
    by = F.when(F.col("secondary") == "chno", F.col("chno").cast("double")).when(F.col("secondary") == "ffid", F.col("ffid").cast("double")).otherwise(F.col("offset_m").cast("double"))
    one = Window.partitionBy(*files, draw)
    met = met.withColumn("_r", F.row_number().over(one.orderBy(by, "trace_idx")) - 1).withColumn("_n", F.count(F.lit(1)).over(one))
    first = F.floor(F.col("_u") * F.greatest(F.col("_n") - height + 1, F.lit(1)))
    met = met.withColumn("row", (F.col("_r") - first).cast("long")).where((F.col("row") >= 0) & (F.col("row") < height))
    return met.select(*files, draw, "key_name", "key", "secondary", "row", "trace_idx", F.greatest(height - F.col("_n"), F.lit(0)).cast("long").alias("pad"))


def background_starts(intervals: DataFrame, keys: list[str], draws: DataFrame) -> DataFrame:
    """keys, draw, start: uniform numbers (keys, draw, u) laid over the total length of each key's intervals (a, z).

    Intervals and draws of a key are sorted together by their place on the summed
    length, so a draw finds its interval without meeting the others.
    """
    w = Window.partitionBy(*keys).orderBy("a")
    spans = intervals.where("z > a").select(*keys, "a", F.expr("z - a").alias("_len"))
    spans = spans.withColumn("_at", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_len"))
    whole = spans.groupBy(*keys).agg(F.sum("_len").alias("_all"))
    laid = draws.join(whole, keys).select(*keys, (F.col("u") * F.col("_all")).alias("_at"), F.struct(F.col("draw").alias("draw")).alias("_d"))
    both = spans.select(*keys, "_at", F.struct("a", F.col("_at").alias("at")).alias("_s")).unionByName(laid, allowMissingColumns=True)
    # at one place the interval that starts there comes before the draws
    sweep = Window.partitionBy(*keys).orderBy("_at", F.col("_d").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_s", F.last("_s", ignorenulls=True).over(sweep)).where("_d is not null")
    return found.select(*keys, "_d.draw", (F.col("_s.a") + F.col("_at") - F.col("_s.at")).alias("start"))


def noise_windows(windows: DataFrame, decisions: DataFrame, keys: list[str], width: int) -> DataFrame:
    """windows decided to be noise as label rows: p and s nowhere, noise everywhere, label_valid where the trace is."""
    quiet = decisions.where("decision = 'noise'").select(*keys)
    flat = lambda v: F.array_repeat(F.lit(v), width)
    return windows.join(quiet, keys).withColumns({"p": flat(0.0), "s": flat(0.0), "noise": flat(1.0), "label_valid": F.col("trace_valid")})
