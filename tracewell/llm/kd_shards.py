"""Operator 8: sharding by k-d tree partitioning. DataFrame functions only.

A node that must become n shards is split along its widest metadata dimension
(log size, log lines, bytes per character; widths relative to the whole table,
all of them properties of the text) at the weighted
median, or where n is odd at the weight share floor(n / 2) / n, until every leaf
is one shard; leaves so reach total bytes / shards.

Along a dimension rows are ordered by a 52-bit key: the quantised value, then a
hash of the text, then a hash of the row. Equal texts therefore stay together
unless a split point falls inside their group, which must be possible because a
group may outweigh a shard. The weighted median is found by counting bytes in
4096 ranges of the key, then in 4096 ranges of the one that holds it, and so on
until its neighbours weigh less than TOLERANCE of the node: all nodes of a level
in one job, one row per node to the driver.

Defined cases: a null text has size 8 and crc32 0; rows that share a doc_id (null ids
too) and repeated rows are rows of their own, told apart by a number written once, so
that a split point can fall between any two; among rows of one shard equal in doc_id
and key the slots are dealt in any order; very long texts are measured whole; an empty
table gives an empty result; other columns of docs are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import materialize, partitions, salted_rank, table

SHARDS = 24
DIMENSIONS = ("d_size", "d_lines", "d_script")
DIGIT = 12
DIGITS = (40, 28, 16, 4, 0)
TOLERANCE = 0.0005


@dataclass
class Node:
    """A leaf with its number of shards, or a split of two nodes at a key of a dimension."""

    shards: int
    first: int
    dim: str = ""
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [*self.left.leaves(), *self.right.leaves()] if self.left else [self]

    def by_leaf(self, value: Callable[[Node], Column]) -> Column:
        """The value of the leaf that a row falls into."""
        if not self.left:
            return value(self)
        return F.when(F.col(self.dim) < self.cut, self.left.by_leaf(value)).otherwise(self.right.by_leaf(value))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and one 52-bit key per dimension; to be written once, as the keys number the rows."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    lines = chars - F.coalesce(F.length(F.replace("text", F.lit("\n"))), F.lit(0))
    step = lambda x: F.least(F.lit(4095), F.floor(x * 100))
    row = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 20))
    same = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) * (1 << 20) + row
    values = {"d_size": step(F.log2(size)), "d_lines": step(F.log2(lines + 1)), "d_script": step((size - 8) / F.greatest(chars, F.lit(1)))}
    rows = docs.select("doc_id", size.alias("size"), F.crc32(raw).alias("text_crc32"), *[(v.cast("long") * (1 << 40) + same).alias(k) for k, v in values.items()])
    return rows


def widest(rows: DataFrame, tree: Node, root: dict[str, int]) -> dict[int, tuple[str, int]]:
    """Per unfinished leaf (by its first shard) the dimension of the largest relative width, and the leaf's bytes."""
    span = [F.max(d) - F.min(d) for d in DIMENSIONS]
    at = tree.by_leaf(lambda x: F.lit(x.first if x.shards > 1 else None).cast("int"))
    found = rows.groupBy(at.alias("node")).agg(F.sum("size").alias("bytes"), *[s.alias(d) for s, d in zip(span, DIMENSIONS, strict=True)]).collect()
    return {r.node: (max(DIMENSIONS, key=lambda d: r[d] / root[d]), r.bytes) for r in found if r.node is not None}


def cuts(rows: DataFrame, tree: Node, dim: dict[int, str], want: dict[int, float], slack: dict[int, float]) -> dict[int, int]:
    """Per leaf the least key of its right part, so that the left part weighs about want bytes."""
    base, low, out = dict.fromkeys(dim, 0), dict.fromkeys(dim, 0.0), {}
    above = DIGITS[0] + DIGIT
    for shift in DIGITS:
        open_ = [n for n in dim if n not in out]
        if not open_:
            break

        def cell(x: Node) -> Column:
            if x.first not in open_ or x.shards == 1:
                return F.lit(None).cast("long")
            key = F.col(dim[x.first])
            return F.when(F.shiftright(key, above) == base[x.first] >> above, F.shiftright(key, shift))

        node = tree.by_leaf(lambda x: F.lit(x.first))
        cells = rows.groupBy(node.alias("node"), tree.by_leaf(cell).alias("cell")).agg(F.sum("size").alias("w")).where("cell is not null")
        upto = Window.partitionBy("node").orderBy("cell")  # at most 4096 cells a node
        pairs = [x for n in open_ for x in (F.lit(n), F.lit(float(want[n] - low[n])))]
        reach = cells.withColumn("cum", F.sum("w").over(upto)).where(F.col("cum") >= F.element_at(F.create_map(*pairs), F.col("node")))
        for r in reach.groupBy("node").agg(F.min(F.struct("cell", "w", "cum")).alias("c")).collect():
            n, below = r.node, low[r.node] + r.c.cum - r.c.w
            if r.c.w <= slack[n] or shift == 0:
                nearer = want[n] - below <= below + r.c.w - want[n]
                out[n] = (r.c.cell if nearer else r.c.cell + 1) << shift
            else:
                base[n], low[n] = r.c.cell << shift, below
        above = shift
    return out


def grow(rows: DataFrame, shards: int = SHARDS) -> Node:
    """The tree over rows, level by level."""
    span = rows.agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first()
    root = {d: span[d] or 1 for d in DIMENSIONS}
    tree = Node(shards, 0)
    while any(x.shards > 1 for x in tree.leaves()):
        open_ = {x.first: x for x in tree.leaves() if x.shards > 1}
        wide = widest(rows, tree, root)
        want = {n: b * (open_[n].shards // 2) / open_[n].shards for n, (_, b) in wide.items()}
        at = cuts(rows, tree, {n: d for n, (d, _) in wide.items()}, want, {n: b * TOLERANCE for n, (_, b) in wide.items()})
        for n, x in open_.items():
            half = x.shards // 2
            x.dim, x.cut = wide.get(n, (DIMENSIONS[0],))[0], at.get(n, 0)
            x.left, x.right = Node(half, x.first), Node(x.shards - half, x.first + half)
    return tree


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    rows = materialize(metadata(docs), "kd-metadata")
    dealt = rows.withColumn("shard", grow(rows, shards).by_leaf(lambda x: F.lit(x.first)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", "d_size"), F.lit(partitions(docs.sparkSession))).cast("int"))
    dealt = salted_rank(dealt, ["shard"], ["doc_id", "d_size"], "part", "slot")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"))
