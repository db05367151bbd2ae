"""The staged pick jobs: each stage takes and gives a table of one row per trace.

run() writes every stage under a folder, by iter_id, and rereads it, so that a
stage that fails is repeated from the table before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import signal as S
from tracewell.operators import assembly, gates, gathers, labels, picks, statics


@dataclass(frozen=True)
class Knobs:
    """Sizes in samples unless named otherwise."""

    dt: float = 0.002
    pmax_th: float = 0.0
    snap_reach: int = 5
    confidence_half: int = 20
    margin: float = 0.2
    section: int = 16
    stride: int = 4
    rounds: int = 3
    trend_sigma: float = 10.0
    low_share: float = 0.05
    half_win: int = 128
    up: int = 2
    max_shift: int = 16
    scan: int = 24
    trough_th: float = 0.1
    radius: int = 3
    support: int = 2
    most_dev: int = 2
    pin_tol: int = 2
    v_min: float = 300.0
    v_max: float = 6000.0
    slope_eps: float = 1e-6
    side_least: int = 16
    diff_th: float = 128.0
    inv_drop: float = 10.0
    inv_steps: int = 2
    discard_radius: int = 32
    sigma_ms: float = 6.0
    var_half: int = 8
    var_sigma_ms: float = 6.0
    var_least: int = 3

    def assembly(self, n_samples: int) -> assembly.AssemblyKnobs:
        names = ("dt", "v_min", "v_max", "slope_eps", "side_least", "diff_th", "inv_drop", "inv_steps", "discard_radius", "sigma_ms", "var_half", "var_sigma_ms", "var_least")
        return assembly.AssemblyKnobs(n_samples=n_samples, **{n: getattr(self, n) for n in names})


def _clean(pick: Column, offset: Column, samples: Column) -> Column:
    """0 for traces at offset 0 and dead traces."""
    dead = (offset == 0) | (F.array_max(F.transform(samples, F.abs)) == 0)
    return F.when(dead, F.lit(0)).otherwise(pick).cast("long")


def stage1(traces: DataFrame, keys: list[str], k: Knobs) -> DataFrame:
    """Probabilities to picks, confidences and a trend.

    traces hold trace_idx, offset_m, samples, prob. Adds pick, pmax, conf_prob,
    pick_snapped, trend_i (null where uncovered) and conf_trend.
    """
    top = F.array_max("prob")
    rows = traces.withColumn("pmax", top).withColumn("pick", _clean(F.when(top < k.pmax_th, F.lit(0)).otherwise(S.argmax(F.col("prob"))), F.col("offset_m"), F.col("samples")))
    rows = rows.withColumn("conf_prob", picks.window_confidence(F.col("prob"), F.col("pick"), k.confidence_half, k.margin)).withColumn("pick_snapped", picks.snap(F.col("samples"), F.col("pick"), "trough", k.snap_reach))
    gather = Window.partitionBy(*keys)
    rows = rows.drop("prob").withColumn("rank", (F.row_number().over(gather.orderBy(F.abs("offset_m"), "trace_idx")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(gather))
    small = rows.select(*keys, "rank", "n", F.abs("offset_m").cast("double").alias("x"), (F.col("pick") * k.dt).alias("y"), (F.col("pick") > 0).cast("int").alias("valid"), F.col("conf_prob").alias("w"))
    trend = statics.robust_trend(small, keys, k.section, k.stride, k.rounds)
    out = rows.join(trend, [*keys, "rank"], "left")
    out = out.withColumn("trend_i", F.when(F.col("covered") & (F.col("trend_t") > 0), F.col("trend_t") / k.dt))
    near = F.exp(-0.5 * F.pow((F.col("pick") - F.col("trend_i")) / k.trend_sigma, 2))
    return out.withColumn("conf_trend", F.when(F.col("pick") > 0, F.coalesce(near, F.lit(0.0))).otherwise(0.0)).drop("rank", "n", "trend_t", "trend_s", "covered")


def with_assembled_trend(stage: DataFrame, keys: list[str], files: list[str], n_samples: int, k: Knobs) -> DataFrame:
    """stage with trend_i and conf_trend of the trend put together from stage 1's (kept as trend_local_i) and the file's.

    The file's trend is fitted to picks weighted by conf_prob, times conf_rs where
    the table has it. Adds trend_local_i, trend_file_i, trend_global_i,
    global_filled, discarded, source.
    """
    by_trace = Window.partitionBy(*keys).orderBy("trace_idx")
    rows = stage.drop("conf_trend").withColumn("rank", (F.row_number().over(by_trace) - 1).cast("long"))
    rows = gathers.signed_offset(rows, keys).withColumn("signed", F.col("signed_offset").cast("double")).drop("rank", "signed_offset")
    weight = F.greatest(F.coalesce("conf_prob", F.lit(0.0)), F.lit(0.0))
    if "conf_rs" in stage.columns:
        weight = weight * F.greatest(F.coalesce("conf_rs", F.lit(0.0)), F.lit(0.0))
    knobs = k.assembly(n_samples)
    rows = assembly.with_global_trend(rows.withColumnRenamed("trend_i", "trend_local_i"), files, "pick", weight, knobs)
    rows = assembly.assembled(rows, keys, "trend_local_i", "trend_file_i", knobs).drop("signed")
    return assembly.trend_confidence(rows, files, "pick", "trend_i", knobs)


def stage2(stage: DataFrame, keys: list[str], k: Knobs, files: list[str] | None = None, n_samples: int = 1 << 30) -> DataFrame:
    """Windows about the assembled trend, and which traces to keep.

    files name the keys of a file (a gather is one unless they are given). Thresholds
    are the low_share percentiles of the scores over all traces with a good pick near
    a good trend. Adds what with_assembled_trend does, reason (bits), keep, start,
    window and window_pick (null unless kept).
    """
    scores = ["conf_prob", "conf_trend", *(["conf_rs"] if "conf_rs" in stage.columns else [])]
    rows = with_assembled_trend(stage, keys, files or keys, n_samples, k)
    rows = rows.withColumn("_base", gates.base_valid_bits(F.col("pick"), F.col("trend_i"), n_samples, k.half_win))
    limits = rows.where("_base = 0").agg(*[F.percentile(c, k.low_share).alias(f"_{c}") for c in scores])
    # limits is one row, whatever the input
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(limits.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    reason = F.col("_base") + gates.score_bits([(F.col(c), F.col(f"_{c}")) for c in scores])
    start = F.when(F.col("trend_i").isNotNull(), F.rint("trend_i").cast("long") - k.half_win).otherwise(-1)
    out = rows.withColumn("reason", reason).withColumn("keep", F.col("reason") == 0).withColumn("start", start)
    out = out.withColumn("window", labels.centre_window(F.col("samples"), F.col("trend_i"), k.half_win, k.up))
    out = out.withColumn("window_pick", F.when(F.col("keep"), (F.col("pick") - F.col("start")) * k.up))
    return out.drop("_base", *[f"_{c}" for c in scores])


MADE = ("trend_i", "trend_local_i", "trend_file_i", "trend_global_i", "global_filled", "discarded", "source", "reason", "keep", "start", "window", "window_pick", "pick", "conf_prob", "conf_trend", "conf_rs", "pick_raw", "reason_trough", "pick_final")


def reseeded(stage4_rows: DataFrame) -> DataFrame:
    """Final picks as the seed of another stage 2: pmax in place of conf_prob, cmax (if the table has it) of conf_rs, and no local trend."""
    rows = stage4_rows.select(*[c for c in stage4_rows.columns if c not in MADE], F.col("pick_final").alias("pick"), F.col("pmax").alias("conf_prob"), F.lit(None).cast("double").alias("trend_i"), F.lit("stage4").alias("seed_kind"))
    return rows.withColumn("conf_rs", F.col("cmax")) if "cmax" in rows.columns else rows


def stage4(stage: DataFrame, keys: list[str], order: str, k: Knobs) -> DataFrame:
    """Window picks back to the trace, moved to the preceding trough, agreed with neighbours, snapped.

    Uses window_pick, start, samples; adds pick_raw, reason_trough and pick_final.
    """
    raw = F.rint(F.col("start") + F.col("window_pick") / k.up)
    rows = stage.withColumn("pick_raw", F.when((raw > 0) & (raw < F.size("samples")), raw).otherwise(0).cast("long"))
    rows = picks.trough_shift(rows.drop("reason"), "pick_raw", "samples", k.max_shift, k.scan, k.trough_th)
    rows = rows.withColumnRenamed("reason", "reason_trough").withColumn("p_in", F.col("pick_raw")).withColumn("p_post", F.col("shifted"))
    rows = picks.consensus(rows, keys, order, k.radius, k.support, k.most_dev, k.max_shift, k.pin_tol)
    inside = F.when((F.col("p_out") > 0) & (F.col("p_out") < F.size("samples")), F.col("p_out")).otherwise(0)
    return rows.withColumn("pick_final", picks.snap(F.col("samples"), inside, "trough", k.snap_reach)).drop("p_in", "p_post", "p_out", "shifted", "peak_i", "trough_i")


STAGES = {"stage1": "pick", "stage2": "window_pick", "stage4": "pick_final"}


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: its mark is there."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def run(spark: SparkSession, traces: DataFrame, keys: list[str], folder: str, iter_id: int, k: Knobs, stages: tuple[str, ...] = tuple(STAGES), files: list[str] | None = None, n_samples: int = 1 << 30) -> dict[str, int]:
    """Writes the named stages' tables; gives the traces each left without a pick.

    A table of this iter_id that was written to its end is taken as it is, so a
    failed run goes on at the stage that failed. From iter_id 1 on stage1 is the
    reseeded stage4 of the iteration before. Stages not named must be there if a
    later one is.
    """
    skipped, rows = {}, traces
    work = {"stage1": lambda r: stage1(r, keys, k) if iter_id == 0 else reseeded(spark.read.parquet(f"{folder}/stage4/iter_id={iter_id - 1}")), "stage2": lambda r: stage2(r, keys, k, files, n_samples), "stage4": lambda r: stage4(r, keys, "trace_idx", k)}
    last = max((i for i, name in enumerate(STAGES) if name in stages), default=-1)
    for name in list(STAGES)[: last + 1]:
        path = f"{folder}/{name}/iter_id={iter_id}"
        if name in stages and not _finished(spark, path):
            work[name](rows).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        if name in stages:
            skipped[name] = rows.where(F.col(STAGES[name]).isNull() | (F.col(STAGES[name]) == 0)).count()
    return skipped


def missing_inputs(listed: DataFrame, traces: DataFrame, keys: list[str]) -> DataFrame:
    """Listed gathers of which traces hold none: what a run never saw."""
    return listed.select(*keys).distinct().join(traces.select(*keys).distinct(), keys, "left_anti")
