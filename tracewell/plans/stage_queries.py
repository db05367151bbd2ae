"""Queries of the staged jobs over the waveform view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.plans import stages
from tracewell.plans.catalog import query, rounded
from tracewell.plans.trend_queries import _tiles

KEYS = ["ffid", "tile"]
KNOBS = stages.Knobs(dt=0.004, pmax_th=0.05, confidence_half=5, half_win=16, max_shift=6, scan=12)


def _traces(spark, sf_dir):
    from tracewell.functions.signal import softmax

    rows = _tiles(spark, sf_dir).select(*KEYS, "trace_idx", "offset_m", "samples")
    return rows.withColumn("prob", softmax(F.col("samples"), 20.0))


def _first(spark, sf_dir):
    return stages.stage1(_traces(spark, sf_dir), KEYS, KNOBS)


@query(None)
def stage1_picks(spark, sf_dir):
    return _first(spark, sf_dir).select(*KEYS, "trace_idx", "pick", "pick_snapped", rounded("pmax"), rounded("conf_prob"), rounded("trend_i"), rounded("conf_trend"))


@query(None)
def stage2_windows(spark, sf_dir):
    out = stages.stage2(_first(spark, sf_dir), KEYS, KNOBS)
    return out.select(*KEYS, "trace_idx", "reason", "keep", "start", "window_pick", F.size("window").alias("width"))


@query(None)
def stage4_picks(spark, sf_dir):
    out = stages.stage4(stages.stage2(_first(spark, sf_dir), KEYS, KNOBS), KEYS, "trace_idx", KNOBS)
    return out.select(*KEYS, "trace_idx", "pick_raw", "reason_trough", "pick_final")
