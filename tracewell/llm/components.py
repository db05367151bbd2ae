"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialize, remove

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every linked node with the least node it reaches.

    edges has long columns u, v, u <> v; nodes without a link have no row. Each
    round is written to the shared folder; the rounds grow with the logarithm of
    the component's size, and a round's folder goes when the next is written. Stars of a hub are joined on the hub; only its
    neighbours are moved, and adaptive execution splits such a key.
    """
    now = materialize(edges.distinct(), "links")
    state = None
    for _ in range(MAX_ROUNDS):
        last, now = now, materialize(_small_star(_large_star(now)), "links")
        remove(edges.sparkSession, *{f.rpartition("/")[0] for f in last.inputFiles()})
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (sums.n, sums.h) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (sums.n, sums.h)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
