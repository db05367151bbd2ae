"""Arrays of one day of samples a file: days, bounds, names, reading in channels and sample blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, day date, channel int, start long, samples array<double>"


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """day: every date from first to last, both yyyyMMdd; an earlier last is an error."""
    a, b = F.to_date(F.lit(first), "yyyyMMdd"), F.to_date(F.lit(last), "yyyyMMdd")
    one = spark.range(1).select(a.alias("a"), b.alias("b"))
    fit = F.when(F.col("b") >= F.col("a"), F.sequence("a", "b")).otherwise(F.raise_error(F.lit("the last day lies before the first")).cast("array<date>"))
    return one.select(F.explode(fit).alias("day"))


def day_name(day: Column, fs: int, pad: int, template: str = "JST_{YYYYMMDD}_{fs}Hz_pad{pad}s.npy") -> Column:
    """The name of a day's file."""
    plain = template.replace("{fs}", str(fs)).replace("{pad}", str(pad))
    head, *tail = plain.split("{YYYYMMDD}")
    parts = [F.lit(head)]
    for t in tail:
        parts += [F.date_format(day, "yyyyMMdd"), F.lit(t)]
    return F.concat(*parts)


def day_bounds(day: Column, pad: int, zone: str = "Asia/Tokyo") -> tuple[Column, Column]:
    """First and last instant (timestamps) of a day of the zone, pad seconds more on both sides."""
    midnight = lambda d: F.to_utc_timestamp(d.cast("timestamp_ntz").cast("string"), zone)
    return midnight(day) - F.make_interval(secs=F.lit(pad)), midnight(F.date_add(day, 1)) + F.make_interval(secs=F.lit(pad))


def sample_of(instant: Column, day: Column, fs: int, pad: int, zone: str = "Asia/Tokyo") -> Column:
    """Place of an instant in its day's array, rounded; null outside of it."""
    lo, hi = day_bounds(day, pad, zone)
    at = (F.unix_micros(instant) - F.unix_micros(lo)) / 1e6 * fs
    return F.when((instant >= lo) & (instant < hi), F.rint(at).cast("long"))


def read_days(spark: SparkSession, folder: str, wanted: DataFrame, fs: int, pad: int, block: int, channels: list[int] | None = None, template: str = "JST_{YYYYMMDD}_{fs}Hz_pad{pad}s.npy") -> DataFrame:
    """path, day, channel, start, samples: the arrays (channels, samples) of wanted days in blocks of samples.

    An array of another length than the day and its padding asks for, or without
    a wanted channel, is an error; a missing file gives no rows (left_anti on day
    finds them). A file is read in one task and must be under 2 GB.
    """
    n = (86400 + 2 * pad) * fs
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(folder)
    named = files.select("path", "content", F.element_at(F.split("path", "/"), -1).alias("name"))
    asked = named.join(wanted.select("day", day_name(F.col("day"), fs, pad, template).alias("name")), "name").select("path", "day", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from io import BytesIO

        for b in batches:
            for path, day, content in b.itertuples(index=False):
                a = np.load(BytesIO(content), allow_pickle=False)
                if a.ndim != 2 or a.shape[1] != n:
                    raise ValueError(f"{path} holds {a.shape}, not (channels, {n})")
                for c in range(a.shape[0]) if channels is None else channels:
                    if not 0 <= c < a.shape[0]:
                        raise ValueError(f"{path} has no channel {c}")
                    starts = list(range(0, n, block))
                    yield pd.DataFrame({"path": path, "day": day, "channel": c, "start": starts, "samples": [a[c, s : s + block].astype(float) for s in starts]})

    return asked.mapInPandas(run, SCHEMA)
