"""Operator 9: SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint takes one vote per 3-word shingle and bit. Fingerprints within 2
bits link. The index is one hierarchy over all distinct fingerprints, sorted by
Gray rank: a node keeps the bits all its fingerprints share (mask and pattern),
and a search drops a whole node as soon as the differences accumulated on its
shared bits exceed 2.

1. Distinct fingerprints are dealt into ranges of Gray rank, of about RANGE each.
   A range's own mask and pattern are an upper node: one row a range.
2. The upper nodes, with the hierarchy over them, go to every task; each
   fingerprint descends it and is sent to the ranges that may hold a neighbour
   (its own and later ones: a link is found from its earlier end).
3. A task builds the lower hierarchy of its range and searches it with all that
   came. It hands on one link per fingerprint to the least one it reaches there
   (a spanning star), not its pairs; a fingerprint has at most 2080 neighbours.

Components of the distinct fingerprints give the least doc_id reachable.

Defined cases: null text, empty text and text without a word have fingerprint 0
and link like any other; texts of 1 or 2 words have one shingle; very long texts
vote in parts, whole; a bit with exactly half the votes is 0; repeated rows, and
rows that share a doc_id, are fingerprinted each and share a component if their
texts do; documents with a null doc_id get the component of their fingerprint,
null if it holds no other; an empty table gives an empty result; other columns of docs are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, materialize, table
from tracewell.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Fingerprints of a range of the index, about, and of a small index.
RANGE = 50_000
LEAST = 1000
#: Ranges of an index too small for more: a fingerprint goes to more ranges the more there are, so their number is not the cluster's.
FEW = 16
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words hashed at once.
WORDS = 1 << 16


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    votes, n = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for at in range(0, n, WORDS):
        part = words[at : at + WORDS + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def prepare() -> Callable:
        return lambda texts: (None, [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)])

    return map_texts(docs, ["doc_id"], prepare, "fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a fingerprint in Gray-code order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Hierarchy over nodes (pattern and mask of shared bits) in Gray order; FAN children a node."""

    FAN = 4

    def __init__(self, bits: np.ndarray, mask: np.ndarray | None = None):
        self.levels = [(bits, np.full(len(bits), ~np.uint64(0)) if mask is None else mask)]
        while len(self.levels[-1][0]) > 1:
            bits, mask = self.levels[-1]
            at = np.arange(0, len(bits), self.FAN)
            ones = np.bitwise_and.reduceat(bits | ~mask, at)
            zeros = np.bitwise_and.reduceat(~bits | ~mask, at)
            shared = np.bitwise_and.reduceat(mask, at) & (ones | zeros)
            self.levels.append((ones & shared, shared))

    def near(self, query: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query position, node position) of all bottom nodes within the distance, in blocks of queries."""
        for start in range(0, len(query) if len(self.levels[0][0]) else 0, 512):
            q = np.arange(start, min(start + 512, len(query)))
            node = np.zeros(len(q), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                bits, mask = self.levels[depth]
                ok = np.bitwise_count((query[q] ^ bits[node]) & mask[node]) <= distance
                q, node = q[ok], node[ok]
                if depth:
                    child = node[:, None] * self.FAN + np.arange(self.FAN)
                    real = child < len(self.levels[depth - 1][0])
                    q, node = np.broadcast_to(q[:, None], child.shape)[real], child[real]
            yield q, node


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while (parent[x] != x).any():
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def stars(own: np.ndarray, come: np.ndarray) -> np.ndarray:
    """Rows (fingerprint, least fingerprint reached) of those that came or are a range's own, but for their own least."""
    index = GrayIndex(own[np.argsort(gray_rank(own), kind="stable")])
    every, at = np.unique(np.concatenate([own, come]), return_inverse=True)
    node_at, come_at = np.searchsorted(every, index.levels[0][0]), at[len(own) :]
    parent = np.arange(len(every))
    for q, node in index.near(come):
        a, b = come_at[q], node_at[node]
        while len(a):
            a, b = find(parent, a), find(parent, b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            a, b = low[open_], high[open_]
            np.minimum.at(parent, b, a)
    root = find(parent, np.arange(len(every)))
    signed = every.view(np.int64)
    least = signed.copy()
    np.minimum.at(least, root, signed)
    out = np.stack([signed, least[root]], axis=1)
    return out[out[:, 0] != out[:, 1]]


def nearest(own: np.ndarray, come: np.ndarray) -> np.ndarray:
    """Rows (fingerprint, another within DISTANCE of it) of those that came or are a range's own: its least and its nearest one."""
    index = GrayIndex(own[np.argsort(gray_rank(own), kind="stable")])
    every, at = np.unique(np.concatenate([own, come]), return_inverse=True)
    node_at, come_at = np.searchsorted(every, index.levels[0][0]), at[len(own) :]
    signed = every.view(np.int64)
    least, best, bits = signed.copy(), signed.copy(), np.full(len(every), DISTANCE + 1)
    for q, node in index.near(come):
        a, b = np.concatenate([come_at[q], node_at[node]]), np.concatenate([node_at[node], come_at[q]])
        a, b = a[a != b], b[a != b]
        np.minimum.at(least, a, signed[b])
        apart = np.bitwise_count(every[a] ^ every[b])
        order = np.lexsort((signed[b], apart, a))
        first = order[np.append(True, np.diff(a[order]) > 0)[: len(a)]]
        first = first[apart[first] < bits[a[first]]]
        best[a[first]], bits[a[first]] = signed[b[first]], apart[first]
    out = np.concatenate([np.stack([signed, x], axis=1) for x in (least, best)])
    return out[out[:, 0] != out[:, 1]]


def ranges(fps: DataFrame) -> DataFrame:
    """(part, fp): distinct fingerprints dealt into ranges of Gray rank."""
    n = fps.count()
    count = max(n // RANGE, min(FEW, n // LEAST), 1)
    rank = F.col("fp")
    for k in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, k))
    dealt = fps.repartitionByRange(count, rank.bitwiseXOR(F.lit(-(1 << 63))))  # unsigned order
    return materialize(dealt.select(F.spark_partition_id().alias("part"), "fp"), "gray-ranges")


def upper_nodes(dealt: DataFrame) -> pd.DataFrame:
    """part, bits, mask of every range: one row for about RANGE fingerprints."""
    shared = dealt.groupBy("part").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros"))
    found = sorted(shared.collect())
    ones, zeros = (np.array([r[k] for r in found], np.int64).view(np.uint64) for k in (1, 2))
    return pd.DataFrame({"part": np.array([r.part for r in found], np.int64), "bits": ones, "mask": ones | zeros})


def links(fps: DataFrame, found: Callable[[np.ndarray, np.ndarray], np.ndarray] = stars) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints within DISTANCE bits; with nearest, every link joins two of them."""
    dealt = ranges(fps)
    upper = upper_nodes(dealt)
    shared = dealt.sparkSession.sparkContext.broadcast(tuple(upper[c].to_numpy() for c in upper.columns))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, bits, mask = shared.value
        top = GrayIndex(bits, mask)
        for b in batches:
            fp, home = b["fp"].to_numpy(np.int64), b["part"].to_numpy(np.int64)
            for q, node in top.near(fp.view(np.uint64)):
                ahead = part[node] >= home[q]
                q, to = q[ahead], part[node[ahead]]
                yield pd.DataFrame({"part": to, "came": (to != home[q]).astype(np.int32), "fp": fp[q]})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by range, its own fingerprints first."""
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def work(came: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            own = np.unique(fp[came == 0].view(np.uint64))
            return pd.DataFrame(found(own, np.unique(fp.view(np.uint64))), columns=["u", "v"])

        for b in batches:
            rest = [np.concatenate([x, b[c].to_numpy(np.int64)]) for x, c in zip(rest, ("part", "came", "fp"), strict=True)]
            cut = [0, *(np.flatnonzero(np.diff(rest[0])) + 1).tolist()]
            for x, y in zip(cut, cut[1:], strict=False):
                yield work(rest[1][x:y], rest[2][x:y])
            rest = [x[cut[-1] :] for x in rest]
        if len(rest[0]):
            yield work(*rest[1:])

    sent = dealt.select("part", "fp").mapInPandas(route, "part long, came int, fp long")
    return sent.repartition(max(len(upper), 1), "part").sortWithinPartitions("part", "came").mapInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    group = components(links(distinct.select("fp")))
    rooted = distinct.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def op9_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
