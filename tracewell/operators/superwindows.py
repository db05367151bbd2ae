"""A gather with its nearest gathers: by centroid, else by place in the order of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.gathers import knn


def by_rank(gathers: DataFrame, keys: list[str], key: str, half: int) -> DataFrame:
    """keys, key, member: the half keys before and behind a key within its file, and itself."""
    w = Window.partitionBy(*keys).orderBy(key)
    ranked = gathers.select(*keys, key).distinct().withColumn("_r", F.row_number().over(w))
    near = ranked.select(*keys, key, F.explode(F.sequence(F.col("_r") - half, F.col("_r") + half)).alias("_r"))
    return near.join(ranked.withColumnRenamed(key, "member"), [*keys, "_r"]).select(*keys, key, "member")


def by_centroid(centroids: DataFrame, key: str, half: int, cell: float) -> DataFrame:
    """key, member: the 1 + 2 * half nearest keys by centroid (key, x, y), itself first, ties by key."""
    found = knn(centroids.select(F.col(key).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), 2 * half, cell)
    others = found.select(F.col("id").alias(key), F.col("neighbour").alias("member"))
    return centroids.select(key, F.col(key).alias("member")).unionByName(others)


def superwindow(gathers: DataFrame, keys: list[str], key: str, centroids: DataFrame, half: int, cell: float) -> DataFrame:
    """keys, key, member, by: gathers (keys, key) with the gathers taken beside them.

    Keys with a centroid (centroids: key, x, y, without nulls) take their nearest
    ones that the file holds; others take half keys on each side in the file.
    Without centroids all go by rank.
    """
    held = gathers.select(*keys, key).distinct()
    near = by_centroid(centroids, key, half, cell)
    placed = held.join(near, key).join(held.withColumnRenamed(key, "member"), [*keys, "member"], "left_semi")
    plain = by_rank(held, keys, key, half).join(centroids.select(key), key, "left_anti")
    return placed.select(*keys, key, "member", F.lit("centroid").alias("by")).unionByName(plain.select(*keys, key, "member", F.lit("rank").alias("by")))
