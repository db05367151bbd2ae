"""Path lists: one path a line, optional JSON after a tab or blank; # starts a comment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(lines: DataFrame, meta_schema: str = "map<string,string>") -> DataFrame:
    """path, meta from a column value of lines; blank lines and comments are left out."""
    text = F.trim("value")
    rows = lines.select(text.alias("value")).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    json = F.regexp_extract("value", r"[ \t]+(\{.*\})$", 1)
    path = F.trim(F.regexp_replace("value", r"[ \t]+\{.*\}$", ""))
    return rows.select(path.alias("path"), F.when(json != "", F.from_json(json, meta_schema)).alias("meta"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return manifest(spark.read.text(path))
