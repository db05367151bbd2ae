"""Scored traces stitched into SEG-Y files like their input, of any size.

Every trace has its byte offset, so tasks write trace ranges into a hidden file side
by side; a task that runs again writes the same bytes to the same places. Files come
to their names when all ranges are written. Input and output lie in a folder that all
executors share and that lets files be written in place.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources import segy
from tracewell.sources.segy_ranges import HEAD, cached_headers, listing, local, opened, read_at

#: Traces whose headers are read and whose rows are written at once.
ROWS = 256


def missing_traces(headers: DataFrame, scored: DataFrame) -> DataFrame:
    """file, ffid, trace_idx of traces without a scored row."""
    return headers.join(scored.select("file", "trace_idx"), ["file", "trace_idx"], "left_anti").select("file", "ffid", "trace_idx")


def fill_report(headers: DataFrame, scored: DataFrame) -> DataFrame:
    """file, n_traces, n_filled, n_repeated, n_strange, ns, even of every file.

    n_repeated: rows of a trace beyond its first; n_strange: rows without a trace of the
    file; even: all rows have ns samples.
    """
    rows = scored.groupBy("file", "trace_idx").agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("samples")).alias("low"), F.max(F.size("samples")).alias("high"))
    both = headers.select("file", "trace_idx", F.lit(True).alias("known")).join(rows, ["file", "trace_idx"], "full")
    return both.groupBy("file").agg(
        F.count_if("known").alias("n_traces"),
        F.count_if(F.col("known") & F.col("rows").isNotNull()).alias("n_filled"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("n_repeated"),
        F.count_if(F.col("known").isNull()).alias("n_strange"),
        F.max("high").alias("ns"),
        (F.min("low") == F.max("high")).alias("even"),
    )


def target(path: str, root: str, out: str) -> str:
    """Where a source file goes: the same place under out."""
    return os.path.join(local(out), os.path.relpath(local(path), local(root)))


def hidden(path: str) -> str:
    return os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.part")


def stitch(spark: SparkSession, source: str, scored: DataFrame, out: str, cache: str, notes: list[str] | None = None, big: bool = True) -> DataFrame:
    """Write the files of source with the samples of scored (file, trace_idx, samples) under out; their report.

    scored is read several times: hand over a stored table. A file whose traces are
    not all filled once, with one number of samples, is not written; written says so,
    missing_traces names the traces. Samples go out as IEEE floats.
    """
    e = ">" if big else "<"
    headers = cached_headers(spark, source, cache, big)
    report = fill_report(headers, scored).withColumn("written", (F.col("n_filled") == F.col("n_traces")) & (F.col("n_repeated") == 0) & (F.col("n_strange") == 0) & F.col("even"))
    files = report.where("written").join(listing(spark, source).select("file"), "file").select("file", "ns")

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, ns in b.itertuples(index=False):
                with opened(path) as f:
                    head = read_at(f, 0, HEAD)
                    n = (f.seek(0, 2) - HEAD) // (segy.TRACE + 4 * segy.layout(head, big)[1])
                to = target(path, source, out)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(hidden(to), "wb") as f:
                    f.write(segy.file_bytes(head, np.zeros((0, ns)), notes=notes, big=big))
                    f.truncate(HEAD + n * (segy.TRACE + 4 * ns))
            yield b[["file"]]

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, rows in b.groupby("file", sort=False):
                with opened(path) as given, open(hidden(target(path, source, out)), "r+b", buffering=0) as made:
                    head = read_at(given, 0, HEAD)
                    dt, ns_in, _ = segy.layout(head, big)
                    size_in = segy.TRACE + 4 * ns_in
                    for at in range(0, len(rows), ROWS):
                        part = rows.iloc[at : at + ROWS]
                        index, samples = part["trace_idx"].tolist(), np.stack(part["samples"].to_list())
                        traces = b"".join([read_at(given, HEAD + k * size_in, segy.TRACE) + bytes(4 * ns_in) for k in index])
                        raw = segy.file_bytes(head + traces, samples, big=big)[HEAD:]
                        size = segy.TRACE + 4 * samples.shape[1]
                        for k, one in enumerate(index):
                            os.pwrite(made.fileno(), raw[k * size : (k + 1) * size], HEAD + one * size)
            yield b[["file"]].iloc[:0]

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["file"]:
                to = target(path, source, out)
                if os.path.exists(hidden(to)):  # a task that runs again finds its work done
                    os.replace(hidden(to), to)
            yield b[["file"]]

    def done(df: DataFrame, work) -> None:
        df.mapInPandas(work, "file string").write.format("noop").mode("overwrite").save()

    done(files, begun)
    rows = scored.select("file", "trace_idx", "samples").join(files.select("file"), "file", "left_semi")
    done(rows.repartitionByRange("file", "trace_idx").sortWithinPartitions("file", "trace_idx"), filled)
    done(files, named)
    return report
