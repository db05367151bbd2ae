"""Named plans: tables of input and target, a list of channels each, one row a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import labels, sections


def _flat(value: Column) -> Column:
    return F.transform("samples", lambda _: value)


def masked(rows: DataFrame, keys: list[str], ratio: float, seed: str, std: float, add: bool = False, offset: bool = False, normalize: bool = True, dt: float | None = None) -> DataFrame:
    """rows with input (masked trace, then the offset and the time if wanted), target (the trace) and masked.

    rows hold rank, n, trace_idx, offset_m, samples, trace_valid. Of a gather's traces
    a share of ratio, by hash, is replaced by (with add: moved by) normal noise. The
    time is wanted where dt is given.
    """
    rows = labels.trace_mask(rows, keys, ratio, 1, seed)
    hidden = labels.with_noise(F.col("samples"), _flat(F.col("masked")), F.col("trace_idx"), std, seed, add)
    channels = [hidden]
    if offset:
        scaled = labels.offset_channel(keys, "offset_m", F.col("trace_valid")) if normalize else F.col("offset_m").cast("double")
        rows = rows.withColumn("_o", scaled)
        channels.append(_flat(F.col("_o")))
    if dt is not None:
        channels.append(F.transform("samples", lambda _, t: t * F.lit(dt)))
    return rows.withColumns({"input": sections.stacked(*channels), "target": F.array("samples")}).drop("_o")


def phases(rows: DataFrame, p_picks: str, s_picks: str, width: int, sigma: float) -> DataFrame:
    """rows with input (the trace, width samples) and target (P, S and noise), and label_valid."""
    out = labels.phase_map(rows, p_picks, s_picks, width, sigma)
    return out.withColumns({"input": F.array(sections.crop_or_pad(F.col("samples"), width, F.lit(0))), "target": F.array("p", "s", "noise")}).drop("p", "s", "noise")


def pairs(given: DataFrame, wanted: DataFrame, keys: list[str], eps: float = 1e-6) -> DataFrame:
    """given with input and target: traces of two surveys by keys, both scaled by the given one's mean and deviation; unequal lengths are an error."""
    met = given.join(wanted.select(*keys, F.col("samples").alias("_y")), keys)
    met = met.withColumn("_z", sections.pair_standardized(F.col("samples"), F.col("_y"), eps))
    both = sections.stacked(F.col("_z.x"), F.col("_z.y"))
    return met.withColumn("_b", both).withColumns({"input": F.array(F.get("_b", F.lit(0))), "target": F.array(F.get("_b", F.lit(1))), "mean": F.col("_z.mean"), "std": F.col("_z.std")}).drop("_b", "_y", "_z")
