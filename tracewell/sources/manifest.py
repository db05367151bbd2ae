"""File manifests, data ids, lineage columns, table contracts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, root: str, pattern: str = "*.{sgy,segy}") -> DataFrame:
    """path, size, mtime of the matching files below root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def data_id(manifest: DataFrame, keys: list[str]) -> DataFrame:
    """keys, data_id: 12 hex digits over the sorted digests of a group's rows.

    Rows are digested first, so that a group gathers one short string a file.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(c for c in manifest.columns if c not in keys))), 256)
    part = manifest.select(*keys, row.alias("_d")).groupBy(*keys).agg(F.sort_array(F.collect_list("_d")).alias("_a"))
    return part.select(*keys, F.substring(F.sha2(F.array_join("_a", ","), 256), 1, 12).alias("data_id"))


def with_lineage(rows: DataFrame, iter_id: int, model_id: str, config: Mapping[str, object], revision: str, seed_kind: str | None = None) -> DataFrame:
    """Adds iter_id, source_model_id, cfg_hash, git_sha and seed_kind."""
    pairs = [F.lit(f"{k}={config[k]!r}") for k in sorted(config)]
    return rows.withColumns({
        "iter_id": F.lit(iter_id), "source_model_id": F.lit(model_id), "cfg_hash": F.sha1(F.concat_ws("\n", F.lit(""), *pairs)),
        "git_sha": F.lit(revision), "seed_kind": F.lit(seed_kind).cast("string"),
    })


def schema_faults(rows: DataFrame, contract: StructType) -> list[str]:
    """What a table lacks of its contract: missing columns and other types, in the contract's order."""
    have = {f.name: f.dataType for f in rows.schema}
    out = [f"{f.name} is missing" for f in contract if f.name not in have]
    return out + [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in contract if f.name in have and have[f.name] != f.dataType]


def paired(windows: DataFrame, picks: DataFrame) -> DataFrame:
    """Window files that have a pick file of the same folder and stem (up to the first dot)."""
    stem = F.regexp_replace("path", r"\.[^/]*$", "")
    return windows.withColumn("_s", stem).join(picks.select(stem.alias("_s")).distinct(), "_s", "left_semi").drop("_s")
