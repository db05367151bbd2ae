"""The pipeline's near-duplicate stage: texts whose 5-word shingle sets have a
Jaccard similarity of 0.8 or more are linked; one row of each component stays.

Operator 9 comes first: its SimHash fingerprints, searched by its Gray-order
index, give the candidates within its 2 bits. What they miss is found after it
and only between components that it left apart: at similarity 0.8 two 64-bit
fingerprints differ in about 10 bits, and in up to 20 now and then, which no
index of their bits can bound. So the rest meets by segments of the shingles:
the least of each of BANDS * ROWS hash orders, ROWS of them a segment. A pair at
0.8 misses all segments with a chance of 3 in a million, a closer pair with less.

1. Rows with equal shingle sets (64-bit hash) are one node. A node and the least
   one of its fingerprint (operator 9's), and the least nodes of a fingerprint and
   of the least and the nearest one that the Gray index finds near it, are
   candidates; checked as in 3 they give the first components.
2. Nodes meet by segment. In a bucket of up to SMALL nodes all pairs of different
   components within WIDE bits of the fingerprints of their shingle sets are
   candidates; in a larger one only those with the node next to the bucket's
   majority fingerprint.
3. Candidates are checked exactly, on the texts; what holds gives components.
4. In a larger bucket the nodes outside its greatest component are then compared
   with the nodes of other components by a finer sketch of 512 shingle minima: first
   the few most alike, and in the last round all pairs that the sketch does not
   rule out. A pair is compared in the first segment it shares, not in each (where
   that bucket is small, step 2 had the pair). So no pair of a bucket is left
   undecided but by the sketch's chance of 1 in a million, and nodes that one link
   has tied to a group cost nothing more.

Defined cases: words are folded as in op9; a text of 1 to 4 words has one
shingle; null texts, empty texts and texts without a word are one node; an empty
table gives an empty result. Rows are told apart by an id written once, so null
and shared doc_ids are rows like any other; of a component the row with the
least doc_id stays (null last; ties go to the least hash of the text, rows equal in
both are any of them). Texts are read whole however long; other columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, materialize, partitions, restored, settled, shielded
from tracewell.llm.components import components
from tracewell.llm.simhash import LOWER, SEED, fingerprint, links, nearest

SHINGLE = 5
#: Jaccard similarity from which texts are linked, as a fraction.
ALIKE = (4, 5)
BANDS = 32
ROWS = 5
WIDE = 26
SMALL = 4
#: Nodes asked for in the rounds after the first; the last takes all.
NEAREST = (4, None)
#: Of DIGITS bytes a pair at 0.8 shares 410, fewer than SURE (5 deviations below) with a chance of about 1 in a million.
DIGITS, SURE = 512, 364
_RNG = np.random.default_rng(SEED)
MASK = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
FACTOR = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
FINE_MASK = _RNG.integers(0, 1 << 64, (DIGITS, 1), np.uint64)
FINE_FACTOR = _RNG.integers(0, 1 << 64, (DIGITS, 1), np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    found = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return ALIKE[1] * both >= ALIKE[0] * (len(x) + len(y) - both)


def sketch(h: np.ndarray) -> tuple[int, np.ndarray]:
    """SimHash fingerprint and segment keys of a shingle set."""
    import xxhash

    votes, low = np.zeros(64, np.int64), np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 1024):
        part = h[at : at + 1024]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        low = np.minimum(low, ((part ^ MASK) * FACTOR).min(axis=1))
    fp = np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0]
    keys = [xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))] if len(h) else []
    return int(fp), np.array(keys, np.uint64).view(np.int64)


def sketches(rows: DataFrame) -> DataFrame:
    """_row, node (hash of the shingle set), print (operator 9's fingerprint), fp, bands."""

    def prepare() -> Callable:
        import xxhash

        def work(texts: list[str | None]) -> tuple[None, list]:
            sets = [shingles(t) for t in texts]
            node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            made = [sketch(h) for h in sets]
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            return None, [node, prints, np.array([m[0] for m in made], np.int64), [m[1] for m in made]]

        return work

    return map_texts(rows, ["_row"], prepare, "node long, print long, fp long, bands array<long>")


def gray_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct (u, v), u < v: nodes (node, print) whose fingerprints operator 9's index finds equal or near."""
    prints = materialize(nodes.groupBy("print").agg(F.min("node").alias("first")), "prints")
    same = nodes.join(prints, "print").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    one, two = (prints.select(F.col("print").alias(p), F.col("first").alias(n)) for p, n in (("u", "a"), ("v", "b")))
    met = links(prints.select(F.col("print").alias("fp")), nearest).join(one, "u").join(two, "v")
    return same.unionByName(met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= WIDE


def _first(node: np.ndarray, fp: np.ndarray, root: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of every bucket, of different components: all pairs of a small one, a star in a large one."""
    for n in range(2, SMALL + 1):
        at = starts[sizes == n]
        for i in range(n):
            for j in range(i):
                near = _near(fp[at + i], fp[at + j]) & (root[at + i] != root[at + j])
                yield node[at + i][near], node[at + j][near]
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        f, x, r = fp[s : s + n], node[s : s + n], root[s : s + n]
        bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * bits > n, bitorder="little").view("<i8")[0]
        c = int(np.lexsort((x, np.bitwise_count((f ^ middle).view(np.uint64))))[0])
        near = _near(f, f[c]) & (r != r[c])
        yield x[near], np.full(int(near.sum()), x[c])


def digits(texts: DataFrame) -> DataFrame:
    """node, digits: a byte of each of DIGITS least shingle hashes; equal ones estimate similarity."""

    def least(h: np.ndarray) -> bytes:
        low = np.full(DIGITS, ~np.uint64(0))
        for at in range(0, len(h), 256):
            low = np.minimum(low, ((h[at : at + 256] ^ FINE_MASK) * FINE_FACTOR).min(axis=1))
        return (low * FINE_FACTOR[0] >> np.uint64(56)).astype(np.uint8).tobytes()

    return map_texts(texts, ["node"], lambda: lambda given: (None, [[least(shingles(t)) for t in given]]), "digits binary")


def _here_first(b: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: int) -> np.ndarray:
    """Whether the first of the segments that rows i and j of b share is this bucket's."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 65536):
        x, y = b[i[k : k + 65536]], b[j[k : k + 65536]]
        at = (x == y).argmax(axis=1)
        out[k : k + 65536] = x[np.arange(len(x)), at] == bucket
    return out


def _apart(most: int | None, bucket: np.ndarray, node: np.ndarray, fp: np.ndarray, root: np.ndarray, sketched: np.ndarray, bands: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes outside a large bucket's greatest component, each with nodes of other components that may be alike: the most likely ones, all for None."""
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        f, x, r = fp[s : s + n], node[s : s + n], root[s : s + n]
        roots, rows = np.unique(r, return_counts=True)
        outside = np.flatnonzero(r != roots[rows.argmax()])
        if not len(outside):
            continue
        d, b = np.frombuffer(b"".join(sketched[s : s + n]), np.uint8).reshape(n, DIGITS), np.stack(bands[s : s + n])
        block = max(1, (1 << 22) // n)
        for at in range(0, len(outside), block):
            i, j = np.nonzero((r[outside[at : at + block], None] != r) & _near(f[outside[at : at + block], None], f))
            i = outside[at + i]
            here = _here_first(b, i, j, int(bucket[s]))
            i, j = i[here], j[here]
            same = np.concatenate([np.zeros(0, int), *[(d[i[k : k + 65536]] == d[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)]])
            i, j, same = i[same >= SURE], j[same >= SURE], same[same >= SURE]
            if most is not None and len(i):
                order = np.lexsort((x[j], -same, i))
                i, j = i[order], j[order]
                first = np.searchsorted(i, i)
                near = np.arange(len(i)) - first < most
                i, j = i[near], j[near]
            yield x[i], x[j]


def candidates(buckets: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct (u, v), u < v; buckets: bucket, node, fp, root and, after the first round, digits and bands."""
    names = buckets.columns[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pd.DataFrame]:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
            sizes = np.diff(np.append(starts, len(bucket)))
            for a, b in _apart(most, bucket, *columns, starts, sizes) if len(columns) > 3 else _first(*columns, starts, sizes):
                u, v = np.minimum(a, b), np.maximum(a, b)
                yield pd.DataFrame({"u": u[u != v], "v": v[u != v]})

        parts: list[list[np.ndarray]] = []  # batches of a bucket that is not complete yet
        for b in batches:
            part = [b[c].to_numpy() for c in ["bucket", *names]]
            if not len(part[0]):
                continue
            k = int(np.searchsorted(part[0], part[0][-1]))
            if k or (parts and parts[-1][0][-1] != part[0][0]):
                yield from work(*map(np.concatenate, zip(*parts, [x[:k] for x in part], strict=True)))
                parts = []
            parts.append([x[k:] for x in part])
        if parts:
            yield from work(*map(np.concatenate, zip(*parts, strict=True)))

    dealt = buckets.repartition(partitions(buckets.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(run, "u long, v long").distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose similarity, computed from the texts (node, text), holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = lru_cache(512)(shingles)
        for b in batches:
            holds = np.array([alike(of(x), of(y)) for x, y in zip(b["a"], b["b"], strict=True)], bool)
            yield b.loc[holds, ["u", "v"]]

    one = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    two = texts.select(F.col("node").alias("v"), F.col("text").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))


def _texts(rows: DataFrame, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """node, text of the nodes met."""
    return nodes.join(met.distinct(), "node", "left_semi").select("node", "_row").join(rows, "_row").select("node", "text")


def near_copies(rows: DataFrame) -> DataFrame:
    """(_row, root) of every row of rows (_row, text): equal roots are one component."""
    made = materialize(sketches(rows), "sketches")
    nodes = made.join(made.groupBy("node").agg(F.min("_row").alias("_row")), ["node", "_row"])
    nodes = materialize(nodes, "nodes")
    tried = materialize(gray_pairs(nodes.select("node", "print")), "gray-pairs")
    texts = materialize(_texts(rows, nodes, _ends(tried)), "texts")
    found = materialize(verified(tried, texts), "alike")
    group = components(found)
    buckets = nodes.join(group, "node", "left").select(F.explode("bands").alias("bucket"), "node", "fp", F.coalesce("root", "node").alias("root"))
    first = materialize(candidates(buckets).join(tried, ["u", "v"], "left_anti"), "candidates")
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node", "fp")
    large = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select("bucket")
    crowded = materialize(buckets.join(large, "bucket"), "crowded")
    texts = materialize(_texts(rows, nodes, _ends(first).unionByName(crowded.select("node"))), "texts")
    tried = tried.unionByName(first)
    found = found.unionByName(materialize(verified(first, texts), "alike"))
    group = components(found)
    fine = digits(texts.join(crowded.select("node").distinct(), "node", "left_semi"))
    fine = materialize(fine.join(nodes.select("node", "bands"), "node"), "digits")
    for most in NEAREST:
        again = crowded.join(group, "node", "left").select("bucket", "node", "fp", F.coalesce("root", "node").alias("root")).join(fine, "node").select("bucket", "node", "fp", "root", "digits", "bands")
        more = materialize(candidates(again, most).join(tried, ["u", "v"], "left_anti"), "candidates")
        late = materialize(verified(more, texts), "alike")
        tried = tried.unionByName(more)
        if not late.isEmpty():
            found = found.unionByName(late)
            group = components(found)
    return made.select("_row", "node").join(group, "node", "left").select("_row", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component; the columns of docs."""
    rows = materialize(shielded(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_row"))

    def kept() -> DataFrame:
        group = near_copies(rows.select("_row", "text")).join(rows.select("_row", "doc_id", F.xxhash64("text").alias("_hash")), "_row")
        return group.groupBy("root").agg(least.alias("least")).select("least._row")

    return restored(rows.join(settled(docs.sparkSession, "kept", kept), "_row", "left_semi"), docs)
