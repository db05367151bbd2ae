"""Phase-pick files: compressed row lists of P and S picks, one NumPy archive a survey file."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.phases import csr_faults, csr_to_picks

NAMES = ("p_indptr", "p_data", "s_indptr", "s_data")
SCHEMA = "path string, " + ", ".join(f"{n} array<long>" for n in NAMES) + ", problem string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, the four arrays, problem (a missing, nested or non-integer array): one row a file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                out, problem = {}, None
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for n in NAMES:
                        a = z[n] if n in z.files else None
                        if a is None or a.ndim != 1 or a.dtype.kind not in "iu":
                            problem = problem or n
                            a = np.zeros(0, np.int64)
                        out[n] = [a.astype(np.int64)]
                yield pd.DataFrame({"path": [name], **out, "problem": [problem]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return files.select("path", "content").mapInPandas(parse, SCHEMA)


def validated(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(picks, rejected): path, trace_idx, phase, pick of the files in order; path and faults of the others."""
    p = F.transform(csr_faults(F.col("p_indptr"), F.col("p_data")), lambda x: F.concat(F.lit("p "), x))
    s = F.transform(csr_faults(F.col("s_indptr"), F.col("s_data"), F.size("p_indptr") - 1), lambda x: F.concat(F.lit("s "), x))
    judged = files.withColumn("faults", F.when(F.col("problem").isNotNull(), F.array(F.concat(F.lit("array "), "problem"))).otherwise(F.concat(p, s)))
    good = judged.where(F.size("faults") == 0)
    picks = csr_to_picks(good, ["path"], "p_indptr", "p_data", "P").unionByName(csr_to_picks(good, ["path"], "s_indptr", "s_data", "S"))
    return picks, judged.where(F.size("faults") > 0).select("path", "faults")


def file_bytes(rows: DataFrame, key: str) -> DataFrame:
    """key, content: the archive of every row (key and the four arrays)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            content = []
            for _, r in b.iterrows():
                out = io.BytesIO()
                np.savez(out, **{n: np.asarray(r[n], np.int64) for n in NAMES})
                content.append(out.getvalue())
            yield pd.DataFrame({key: b[key], "content": content})

    return rows.select(key, *NAMES).mapInPandas(write, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")
