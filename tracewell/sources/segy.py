"""SEG-Y files as trace rows.

Reading goes by byte ranges (segy_ranges.py), so a file of any size is split. The
writers `file_bytes` and `like_input` hold a file whole, under 2 GB; for larger ones
see segy_output.py. Sample formats 1 (IBM float) and 5 (IEEE).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, BINARY, TRACE = 3200, 400, 240
#: Byte positions of trace header fields (from 1) and their widths.
FIELDS = {"ffid": (9, 4), "chno": (13, 4), "cmp": (21, 4), "offset_m": (37, 4), "scalar": (71, 2), "sx": (73, 4), "sy": (77, 4), "gx": (81, 4), "gy": (85, 4)}
SCHEMA = "file string, trace_idx long, " + ", ".join(f"{k} int" for k in FIELDS) + ", dt_us int, samples array<float>"


def ibm_to_float(raw: np.ndarray) -> np.ndarray:
    """IBM hexadecimal floats (as uint32) to IEEE."""
    sign = np.where(raw >> 31, -1.0, 1.0)
    power = ((raw >> 24) & 0x7F).astype(np.int32) - 64
    return (sign * (raw & 0xFFFFFF) / float(1 << 24) * 16.0**power).astype(np.float32)


def layout(head: bytes, big: bool = True) -> tuple[int, int, int]:
    """Sample step in microseconds, samples a trace and sample format of a file's first 3600 bytes."""
    dt, ns, kind = (int(np.frombuffer(head, (">" if big else "<") + "u2", 1, TEXT + k)[0]) for k in (16, 20, 24))
    if kind not in (1, 5):
        raise ValueError(f"sample format {kind} is not supported")
    return dt, ns, kind


def header_columns(rows: np.ndarray, big: bool = True, fields: dict[str, tuple[int, int]] = FIELDS) -> dict[str, np.ndarray]:
    """Header fields of traces given as rows of bytes."""
    e = ">" if big else "<"
    return {k: np.ascontiguousarray(rows[:, p - 1 : p - 1 + w]).view(f"{e}i{w}")[:, 0].astype(np.int32) for k, (p, w) in fields.items()}


def sample_rows(rows: np.ndarray, kind: int, big: bool = True) -> np.ndarray:
    """Samples of traces given as rows of bytes."""
    raw, e = np.ascontiguousarray(rows[:, TRACE:]), ">" if big else "<"
    return ibm_to_float(raw.view(e + "u4").astype(np.uint32)) if kind == 1 else raw.view(e + "f4").astype(np.float32)


def traces(content: bytes, big: bool = True, headers_only: bool = False) -> dict[str, np.ndarray]:
    dt, ns, kind = layout(content, big)
    body = np.frombuffer(content, np.uint8, offset=TEXT + BINARY)
    size = TRACE + 4 * ns
    if len(body) % size:
        raise ValueError("the file does not hold whole traces")
    rows = body.reshape(-1, size)
    out = header_columns(rows, big)
    out["dt_us"] = np.full(len(rows), dt, np.int32)
    if not headers_only:
        out["samples"] = sample_rows(rows, kind, big)
    return out


def read(spark: SparkSession, path: str, big: bool = True, headers_only: bool = False) -> DataFrame:
    """One row per trace; headers_only leaves the samples null and unread."""
    from tracewell.sources import segy_ranges

    found = segy_ranges.scan(segy_ranges.listing(spark, path), big=big, headers_only=headers_only)
    return found.withColumn("samples", F.lit(None).cast("array<float>")) if headers_only else found


def file_bytes(like: bytes, samples: np.ndarray, index: np.ndarray | None = None, dt_us: int | None = None, notes: list[str] | None = None, big: bool = True) -> bytes:
    """A file with the headers of `like` and new samples, in its sample format if that is IEEE, else as IEEE.

    index picks the traces kept (each once). notes replace the last lines of the
    40 text lines. Sample count and step are set in all headers.
    """
    e = ">" if big else "<"
    ns_in = int(np.frombuffer(like, e + "u2", 1, TEXT + 20)[0])
    rows = np.frombuffer(like, np.uint8, offset=TEXT + BINARY).reshape(-1, TRACE + 4 * ns_in)
    index = np.arange(len(rows)) if index is None else np.asarray(index)
    if len(np.unique(index)) != len(index) or len(index) != len(samples):
        raise ValueError("every trace needs one row of samples, once")
    head = bytearray(like[: TEXT + BINARY])
    for k, note in enumerate(reversed(notes or [])):
        line = f"C{40 - k:2d} {note}"[:80].ljust(80)
        head[TEXT - 80 * (k + 1) : TEXT - 80 * k] = line.encode("cp037" if like[:1] == b"\xc3" else "ascii", "replace")
    step = dt_us or int(np.frombuffer(like, e + "u2", 1, TEXT + 16)[0])
    for at, value in ((16, step), (20, samples.shape[1]), (24, 5)):
        head[TEXT + at : TEXT + at + 2] = np.array([value], e + "u2").tobytes()
    out = np.zeros((len(index), TRACE + 4 * samples.shape[1]), np.uint8)
    out[:, :TRACE] = rows[index, :TRACE]
    for at, value in ((114, samples.shape[1]), (116, step)):
        out[:, at : at + 2] = np.frombuffer(np.array([value], e + "u2").tobytes(), np.uint8)
    out[:, TRACE:] = np.ascontiguousarray(samples, e + "f4").view(np.uint8).reshape(len(index), 4 * samples.shape[1])
    return bytes(head) + out.tobytes()


def like_input(spark: SparkSession, source: str, traces: DataFrame, notes: list[str] | None = None, big: bool = True) -> DataFrame:
    """file, content: the source files with the samples of (file, trace_idx, samples) rows.

    A file's traces meet its bytes in one task, as in reading. Files without
    rows are left out; traces without a row are dropped from their file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{sgy,segy}").load(source).select(F.col("path").alias("file"), "content")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"file": [], "content": []})
        right = right.sort_values("trace_idx")
        samples = np.stack(right["samples"].to_list())
        return pd.DataFrame({"file": [key[0]], "content": [file_bytes(left["content"].iloc[0], samples, right["trace_idx"].to_numpy(), notes=notes, big=big)]})

    return files.groupBy("file").cogroup(traces.select("file", "trace_idx", "samples").groupBy("file")).applyInPandas(run, "file string, content binary")
