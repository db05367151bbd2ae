"""Operator 6: best-two-fit packing into fixed-length sequences.

Documents become token ids plus an end id; only longer ones are cut. Packing
looks at lengths alone, and there are at most CAPACITY of them: the histogram of
lengths is all the driver sees. It fills a sequence greedily with the longest
pieces that fit, then tries to replace the smallest piece by two unpacked ones
that fit the widened gap more tightly, and repeats that filling as often as the
histogram allows. The plan says which ranks of a length go to which place of
which sequences; pieces look their rank up in it.

Ranks are taken inside (length, input partition) and offset by counts, so no
length gathers in one task. Pieces of full length need no plan.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed each, as are rows that share a doc_id, and a null doc_id stays null; of
equally long pieces any may take any of their places, and of equally tight pairs
the one with the longest piece is taken; a text of any length is cut into full
pieces and a rest; an empty table packs nothing; other columns of docs are not
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.bpe import coder, encode_batch, groups, vocabulary
from tracewell.llm.common import map_texts, materialize, salted_rank, table

CAPACITY = 2048
END_ID = 0


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids)."""
    made = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def prepare() -> Callable:
        bpe = coder(path, False)

        def work(texts: list[str | None]) -> tuple[list[int], list]:
            rows = []
            for start, end in groups(texts):
                for n, (ids, _) in enumerate(encode_batch(bpe, texts[start:end]), start):
                    ids = np.append(ids, END_ID).astype("<u4")
                    for k in range(0, len(ids), capacity):
                        part = ids[k : k + capacity]
                        rows.append((n, k // capacity, k, len(part), zlib.crc32(part.tobytes())) + (part.astype(np.int32),) * keep_ids)
            return [r[0] for r in rows], [[r[k] for r in rows] for k in range(1, 5 + keep_ids)]

        return work

    return map_texts(docs, ["doc_id"], prepare, made)


class Lengths:
    """The lengths still unpacked; the longest one under a bound is a bit operation."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.bits = sum(1 << x for x, n in counts.items() if n)

    def longest(self, bound: int) -> int:
        return (self.bits & ((1 << (bound + 1)) - 1)).bit_length() - 1 if bound > 0 else -1

    def take(self, length: int, n: int = 1) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.bits &= ~(1 << length)
        else:
            self.bits |= 1 << length


def two_that_fit(left: Lengths, room: int, more_than: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum over more_than and at most room."""
    best = None
    a = left.longest(room - 1)
    while a * 2 > more_than and a > 0:
        b = left.longest(min(a, room - a))
        if b == a and left.counts[a] < 2:
            b = left.longest(a - 1)
        if b > 0 and a + b > more_than:
            best, more_than = (a, b), a + b
            if more_than == room:
                break
        a = left.longest(a - 1)
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) until nothing is left."""
    left, out = Lengths({k: n for k, n in counts.items() if n}), []
    while left.bits:
        bin_, gap = [], capacity
        while (x := left.longest(gap)) > 0:
            left.take(x)
            bin_.append(x)
            gap -= x
        if gap and bin_:
            small = bin_[-1]
            pair = two_that_fit(left, gap + small, small)
            if pair:
                left.take(small, -1)
                bin_[-1:] = pair
                for x in pair:
                    left.take(x)
        need = {x: bin_.count(x) for x in bin_}
        more = min(left.counts[x] // n for x, n in need.items())
        for x, n in need.items():
            if more:
                left.take(x, n * more)
        out.append((bin_, more + 1))
    return out


def places(bins: list[tuple[list[int], int]]) -> pd.DataFrame:
    """(length, first_rank, copies, per, sequence, offset): ranks of a length to places.

    Ranks first_rank .. first_rank + copies * per - 1 go, per at a time and side
    by side from offset on, to the sequences from the given one on.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, copies in bins:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            per = lengths.count(x)
            rows.append((x, used.get(x, 0), copies, per, sequence, offset))
            used[x] = used.get(x, 0) + copies * per
            offset += x * per
        sequence += copies
    return pd.DataFrame(rows, columns=["length", "first_rank", "copies", "per", "sequence", "offset"])


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column part, any deal of the rows) plus sequence_id and offset."""
    counts = {r.length: r.n for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = places(plan(counts, capacity))
    n_planned = int((slots["sequence"] + slots["copies"]).max()) if len(slots) else 0
    by_length = {k: g.to_numpy()[:, 1:] for k, g in slots.groupby("length")}  # at most 63 distinct lengths a sequence
    shared = pieces.sparkSession.sparkContext.broadcast(by_length)

    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(lengths, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            length_ = int(lengths[rows[0]])
            s = shared.value[length_]
            at = s[np.searchsorted(s[:, 0], ranks[rows], side="right") - 1]
            past = ranks[rows] - at[:, 0]
            out[rows, 0] = at[:, 3] + past // at[:, 2]
            out[rows, 1] = at[:, 4] + past % at[:, 2] * length_
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    ranked = salted_rank(pieces, ["length"], ["doc_id", "piece"], "part", "rank")
    spot = F.pandas_udf(look_up, "sequence_id long, offset long")
    short = ranked.where(F.col("length") < capacity).withColumn("_at", spot("length", "rank"))
    short = short.select(*pieces.columns, "_at.sequence_id", "_at.offset")
    full = ranked.where(F.col("length") == capacity)
    full = full.select(*pieces.columns, (F.col("rank") + n_planned).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full).drop("part")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    pieces = cut(docs, path, capacity, keep_ids).withColumn("part", F.spark_partition_id())
    return place(materialize(pieces, "pieces"), capacity)


def op6_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())
