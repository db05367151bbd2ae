"""Operator 13: periodic runs of words, by longest common extensions on suffix trees.

A run is a stretch of words with a smallest period q that no neighbouring word
extends, of MIN_LENGTH words and two periods or more. Every run holds a Lyndon root:
for one of the two orders of the words, some position's longest Lyndon word is one
period of the run. So the candidates of a text of n words are 2 * n pairs (i, j): j
ends the longest Lyndon word at i, that is, suffix j is the next one smaller than
suffix i. Each is extended to both directions at once:

- right by the common extension of suffixes i and j, left by that of the reversed
  text, both from Ukkonen suffix trees, of the stretch and of its reversal;
- the common extension of two suffixes is the depth of their lowest common ancestor:
  the least depth between two places of the Euler tour, from a sparse table;
- the next smaller suffix comes from the order of the leaves and a stack.

Trees are built for the stretches that can hold a run: all words of a run lie in
WINDOW-word windows that occur again in the text (for a period q of 6 or less 6
words come again after q words, as the run has 12; for a longer one q do). Hashes of
windows find those stretches, one too many now and then, never one too few, and no
run reaches beyond its stretch.

Defined cases: a null text, an empty text and one without a word have no run and
empty collapsed text; a null doc_id counts as the empty text; ties of the greatest
length go to the smallest start, then period; repeated rows are rows each; very long
texts are read whole, their trees need some 1 KB a word of the stretch at hand; an
empty table gives an empty result; other columns of docs are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import map_texts, table

MIN_LENGTH = 12
WINDOW = 6
#: A document in so many, by hash, has its end made periodic.
MADE = 10
_MIX = np.random.default_rng(13).integers(0, 1 << 64, WINDOW, np.uint64) | np.uint64(1)


class SuffixTree:
    """Ukkonen's tree of symbols (1 and more) with an end symbol 0, its Euler tour and constant-time common extensions."""

    def __init__(self, symbols: list[int]):
        self.text = [*symbols, 0]
        self._grow()
        self._tour()

    def _grow(self) -> None:
        text, n = self.text, len(self.text)
        width = max(text) + 1
        start, stop, link, parent, suffix = [0] * (2 * n), [n] * (2 * n), [0] * (2 * n), [0] * (2 * n), [-1] * (2 * n)
        stop[0], made = 0, 1
        child_of: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            fresh = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = child_of.get(key)
                if child is None:
                    child_of[key] = made
                    start[made], parent[made], suffix[made] = i, node, i - waiting + 1
                    made += 1
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    first = start[child]
                    if length and length >= (stop[child] if stop[child] < i else i + 1) - first:
                        span = stop[child] - first
                        edge, length, node = edge + span, length - span, child
                        continue
                    if text[first + length] == c:
                        if fresh:
                            link[fresh] = node
                        length += 1
                        break
                    child_of[key] = made
                    start[made], stop[made], parent[made] = first, first + length, node
                    start[made + 1], parent[made + 1], suffix[made + 1] = i, made, i - waiting + 1
                    start[child], parent[child] = first + length, made
                    child_of[made * width + c] = made + 1
                    child_of[made * width + text[first + length]] = child
                    if fresh:
                        link[fresh] = made
                    fresh = made
                    made += 2
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.parent, self.start, self.suffix = np.array(parent[:made]), np.array(start[:made]), np.array(suffix[:made])
        self.span = np.array(stop[:made]) - self.start
        self.symbol = np.array(text)[self.start[1:]]

    def _walk(self, first: np.ndarray) -> np.ndarray:
        """Nodes in the order of a depth-first tour that takes children by first (of each node but the root)."""
        order = np.lexsort((-first, self.parent[1:])) + 1
        ends = np.cumsum(np.bincount(self.parent[1:], minlength=len(self.parent)))
        begun, inner = np.concatenate([[0], ends[:-1]]).tolist(), (np.diff(ends, prepend=0) > 0).tolist()
        order, ends = order.tolist(), ends.tolist()
        tour, stack = [], [0]
        while stack:
            v = stack.pop()
            tour.append(v)
            if inner[v]:
                stack += order[begun[v] : ends[v]]
        return np.array(tour)

    def _tour(self) -> None:
        """Of the Euler tour the steps down matter: each comes to a node from its parent, the least deep one since the last step."""
        self.tour = self._walk(self.symbol)
        depth, span, parent = [0] * len(self.span), self.span.tolist(), self.parent.tolist()
        for v in self.tour.tolist():
            depth[v] = depth[parent[v]] + span[v]
        leaf = self.suffix[self.tour]
        at = np.flatnonzero(leaf >= 0)
        self.place = np.zeros(len(self.text), np.int64)  # of each suffix in the tour
        self.place[leaf[at]] = at
        self.levels = [np.array(depth, np.int32)[self.parent[self.tour]]]
        while 2 << len(self.levels) - 1 <= len(self.tour):
            below, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, i <> j."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(b - a)[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - (1 << k)])
        return out

    def ranks(self, upward: bool) -> list[int]:
        """Rank of every suffix; downward the words' order is turned round, the end stays least."""
        leaf = self.suffix[self.tour if upward else self._walk(np.where(self.symbol == 0, 0, len(self.text) - self.symbol))]
        leaf = leaf[leaf >= 0]
        out = np.empty(len(leaf), np.int64)
        out[leaf] = np.arange(len(leaf))
        return out.tolist()


def next_smaller(rank: list[int]) -> list[int]:
    """For every suffix but the end, the next suffix that is smaller."""
    out, stack = [0] * (len(rank) - 1), [len(rank) - 1]
    for i in range(len(rank) - 2, -1, -1):
        r = rank[i]
        while rank[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1]
        stack.append(i)
    return out


def runs_of(symbols: np.ndarray, least: int = MIN_LENGTH) -> np.ndarray:
    """(start, length, period) of all runs of a stretch, by start, then period."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    ids = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree, back = SuffixTree(ids), SuffixTree(ids[::-1])
    i = np.tile(np.arange(n), 2)
    j = np.array(next_smaller(tree.ranks(True)) + next_smaller(tree.ranks(False)))
    start = i - back.common(n - i, n - j)
    period, length = j - i, j + tree.common(i, j) - start
    ok = length >= np.maximum(least, 2 * period)
    return np.unique(np.stack([start[ok], period[ok], length[ok]], axis=1), axis=0)[:, [0, 2, 1]]


def covered(windows: np.ndarray, n: int) -> np.ndarray:
    """(begin, end) of the maximal stretches of n words that the windows at these places cover."""
    edge = np.zeros(n + 2, np.int64)
    edge[windows + 1] += 1
    edge[windows + WINDOW + 1] -= 1
    inside = np.cumsum(edge) > 0
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def stretches(symbols: np.ndarray) -> list[list[int]]:
    """Stretches of words that lie in windows found again in the stretch: all words of every run."""
    n = len(symbols) - WINDOW + 1
    if n < 2:
        return []
    s = symbols.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += s[k : k + n] * _MIX[k]
    h = (h ^ h >> np.uint64(29)) * _MIX[0]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    one, two = order[:-1][same], order[1:][same]  # places of a window and where it is found next
    for _ in range(2):
        if not len(one):
            return []
        again = np.zeros(n, bool)
        again[one] = again[two] = True
        found = covered(np.flatnonzero(again), len(symbols))
        near = np.searchsorted(found[:, 0], one, "right") == np.searchsorted(found[:, 0], two, "right")
        if near.all():
            break
        one, two = one[near], two[near]
    return [x for x in found.tolist() if x[1] - x[0] >= MIN_LENGTH]


def runs(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of a text, by start, then period."""
    found = [runs_of(symbols[a:b]) + np.array([a, 0, 0]) for a, b in stretches(symbols)]
    return np.concatenate([np.zeros((0, 3), np.int64), *found])


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as they are, or with their end made periodic where the hash of the id says so."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % MADE or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """Words outside runs and those of each run's first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join(words) if keep.all() else b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def described(text: str | None, doc_id: int | None) -> tuple:
    """n_runs, start, length, period, runs_sha256, collapsed_sha256 of one text."""
    words = made_periodic((text or "").encode("utf-8", "surrogatepass").split(), doc_id)
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    found = runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
    best = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return len(found), *best, sha256(lines.encode()).hexdigest(), sha256(collapsed(words, found)).hexdigest()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, runs_sha256, collapsed_sha256 of every row of docs."""

    def prepare() -> Callable:
        def work(texts: list[str | None], ids: pa.Array) -> tuple[None, list]:
            return None, [list(c) for c in zip(*(described(t, i) for t, i in zip(texts, ids.to_pylist(), strict=True)), strict=True)]

        return work

    return map_texts(docs, ["doc_id"], prepare, "n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string", ("doc_id",))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_runs", "start", "length", "period", "1000 * length div period as exponent_milli", "runs_sha256", "collapsed_sha256")
