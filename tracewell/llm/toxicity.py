"""Operator 5: toxic spans by a linear-chain conditional random field.

The labelled tables mark documents, so the labels of their tokens are partial:
every token of a clean document is clean, of a toxic one at least one token is
toxic, which is left open. The chain (two states, a clean virtual token at both
ends) is fitted to that likelihood: of a clean document the all-clean path, of a
toxic one all other paths. A token's weights are those of its lower-cased word
and of the word's first letters (PREFIXES), so inflected and unseen forms of a
toxic stem count too; four weights belong to the moves between states.

Forward-backward marginals give each token its probability; a logistic curve
over their sum and the odds of any path but the clean one gives the document's
score, and tokens of 0.5 or more the offending character offsets. The
curve is fitted on evidence of FOLDS chains, each for the documents left out of it.
PREFIXES and PENALTY were chosen by such folds of training rows of sf0.1.

The sample learned from (the only bound): SAMPLE_DOCS labelled documents of each
class with the least hash, of at most SAMPLE_CHARS characters (longer ones are
not learned from, but scored whole), never those with crc32(doc_id as text) mod
5 = 0. Rows beyond 2 * SAMPLE_DOCS, which only repeated ids bring, are left out.

The recursions work on the ratio of the two states, which a token maps by a 2x2
matrix; all BLOCK-token blocks of a batch are multiplied out side by side.

Defined cases: null and empty texts get the score of no evidence (under 0.5);
without toxic or without clean training rows, or with an empty table, every
score is 0; documents with contradictory labels count as toxic; repeated rows
and rows that share a doc_id are scored each by its own text; a null doc_id is
kept and counts as the empty text for held_out; very long texts are scored
whole; a score of exactly 0.5 counts as toxic; columns of docs whose names clash
with the results' stay out unless asked for, and the pipeline renames them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import crc_mod, hash_sample, map_texts, table

SAMPLE_DOCS = 1200
SAMPLE_CHARS = 20_000
#: Lengths of the first letters that have weights of their own.
PREFIXES = (4, 6)
#: A word or prefix needs so many sample documents, whatever the sample's size.
MIN_DOCS = 3
PENALTY = 0.03
#: Weight of every token, from which the others depart.
BIAS = -4.0
ROUNDS = 48
FOLDS = 2
BLOCK = 128
TOKEN = re.compile(r"[^\W_]+")


@dataclass
class Chain:
    weight: dict[str, float]
    bias: float
    moves: np.ndarray
    curve: np.ndarray

    def token(self, word: str) -> float:
        """Log ratio of the two states that a word speaks for."""
        get = self.weight.get
        return min(15.0, max(-15.0, self.bias + sum(get(f, 0.0) for f in features(word.lower()))))


def features(word: str) -> list[str]:
    return [word] + [f"{word[:k]}-" for k in PREFIXES if len(word) > k]


def scan(e: np.ndarray, lens: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward ratios of all sequences (lens tokens each, one after another) from a clean start.

    A token with state ratio e takes r to e * (a11 r + a01) / (a10 r + a00).
    """
    blocks = -(-lens // BLOCK)
    first = np.cumsum(blocks) - blocks
    within = np.arange(len(e)) - np.repeat(np.cumsum(lens) - lens, lens)
    place = np.repeat(first * BLOCK, lens) + within
    grid = np.ones(int(blocks.sum()) * BLOCK)
    grid[place] = e
    grid = np.ascontiguousarray(grid.reshape(-1, BLOCK).T)
    n = grid.shape[1]
    m = [np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)]
    for x in grid:
        top = (x * (a[1, 1] * m[0] + a[0, 1] * m[2]), x * (a[1, 1] * m[1] + a[0, 1] * m[3]))
        low = (a[1, 0] * m[0] + a[0, 0] * m[2], a[1, 0] * m[1] + a[0, 0] * m[3])
        unit = top[0] + top[1] + low[0] + low[1]
        m = [top[0] / unit, top[1] / unit, low[0] / unit, low[1] / unit]
    enter, state = np.zeros(n), np.zeros(len(lens))
    for k in range(int(blocks.max(initial=0))):
        docs = np.flatnonzero(blocks > k)
        b = first[docs] + k
        enter[b] = state[docs]
        state[docs] = (m[0][b] * enter[b] + m[1][b]) / (m[2][b] * enter[b] + m[3][b])
    out, r = np.empty_like(grid), enter
    for k, x in enumerate(grid):
        r = x * (a[1, 1] * r + a[0, 1]) / (a[1, 0] * r + a[0, 0])
        out[k] = r
    return out.T.reshape(-1)[place]


def flip(lens: np.ndarray) -> np.ndarray:
    """Positions that turn every sequence round."""
    ends = np.cumsum(lens)
    return np.repeat(ends - 1, lens) - (np.arange(int(lens.sum())) - np.repeat(ends - lens, lens))


def forward_backward(e: np.ndarray, lens: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward ratios, backward ratios with the token's own, marginals of state 1."""
    r, back = scan(e, lens, a), flip(lens)
    s = scan(e[back], lens, a.T)[back]
    odds = r * s / e
    return r, s, odds / (1 + odds)


def clean_path(s: np.ndarray, lens: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log probability that all tokens are clean, by document (no token: 0); s: backward ratios."""
    out = np.zeros(len(lens))
    if len(s):
        full = np.flatnonzero(lens)
        out[full] = np.add.reduceat(-np.log1p(a[0, 1] / a[0, 0] * s), (np.cumsum(lens) - lens)[full])
    return out


class Words:
    """The distinct words of a sample, its tokens as their numbers, and the words' features."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        tokens = [np.fromiter((number.setdefault(w.lower(), len(number)) for w in TOKEN.findall(t)), np.int32) for t in texts]
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.ids = np.concatenate([np.zeros(0, np.int32), *tokens])
        own = [features(w) for w in number]
        docs = Counter()
        for t in tokens:
            docs.update({f for k in np.unique(t).tolist() for f in own[k]})
        self.names = sorted(f for f, n in docs.items() if n >= MIN_DOCS)
        index = {f: k for k, f in enumerate(self.names)}
        self.word = np.fromiter((k for k, fs in enumerate(own) for f in fs if f in index), np.int32)
        self.feature = np.fromiter((index[f] for fs in own for f in fs if f in index), np.int32)
        self.n = len(number)


def fit_chain(words: Words, toxic: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, then the bias) and log moves from the chosen documents, by Adam on the penalised likelihood."""
    lens, y = words.lens[chosen], toxic[chosen]
    ids = words.ids[np.repeat(chosen, words.lens)]
    y, lens = y[lens > 0], lens[lens > 0]
    starts, n = np.cumsum(lens) - lens, len(words.names)
    start = np.zeros(n + 5)
    start[n] = BIAS
    theta, first, second = start.copy(), np.zeros(n + 5), np.zeros(n + 5)
    for step in range(1, ROUNDS + 1):
        a = np.exp(theta[n + 1 :].reshape(2, 2))
        of_word = np.bincount(words.word, theta[:n][words.feature], minlength=words.n) + theta[n]
        e = np.exp(np.clip(of_word, -15, 15))[ids]
        r, s, p = forward_backward(e, lens, a)
        clean = np.exp(clean_path(s, lens, a))
        # expected counts move away from the clean path's in toxic documents, toward them in clean ones
        pull = np.where(y == 1, clean / np.maximum(1 - clean, 1e-6), -1.0)
        each = np.repeat(pull, lens)
        prev = np.concatenate([[0.0], r[:-1]])
        prev[starts] = 0
        x = np.stack([np.full(len(s), a[0, 0]), a[0, 1] * s, prev * a[1, 0], prev * a[1, 1] * s])
        moves = (x / x.sum(axis=0) * each).sum(axis=1)
        last = r[starts + lens - 1] * a[1, 0] / (a[0, 0] + r[starts + lens - 1] * a[1, 0])
        moves[0] += (pull * (1 - last)).sum() - (pull * (lens + 1)).sum()
        moves[2] += (pull * last).sum()
        by_word = np.bincount(ids, p * each, minlength=words.n)
        by_feature = np.bincount(words.feature, by_word[words.word], minlength=n)
        slope = np.concatenate([by_feature, [by_word.sum()], moves]) - PENALTY * (theta - start)
        slope[n + 1 :] -= 6 * theta[n + 1 :]  # the open labels say little of the moves
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.25 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[: n + 1], theta[n + 1 :].reshape(2, 2)


def judge(words: Words, weight: np.ndarray, moves: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Evidence of the chosen documents."""
    of_word = np.bincount(words.word, weight[:-1][words.feature], minlength=words.n) + weight[-1]
    ids = words.ids[np.repeat(chosen, words.lens)]
    return evidence(np.exp(np.clip(of_word, -15, 15))[ids], words.lens[chosen], np.exp(moves))[0]


def evidence(e: np.ndarray, lens: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document log(1 + sum of marginals), log odds of any toxic token (over 10), 1; the marginals."""
    out = np.zeros((len(lens), 3))
    out[:, 1], out[:, 2] = -2, 1
    if not len(e):
        return out, e
    full = np.flatnonzero(lens)
    _, s, p = forward_backward(e, lens[full], a)
    at = (np.cumsum(lens) - lens)[full]
    clean = clean_path(s, lens[full], a)
    out[full, 0] = np.log1p(np.add.reduceat(p, at))
    out[full, 1] = np.clip(np.log(np.maximum(-np.expm1(clean), 1e-12)) - clean, -20, 20) / 10
    return out, p


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
    return w


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): the bounded training sample."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).select("doc_id", "toxic")
    rows = hash_sample(rows, "toxic", SAMPLE_DOCS)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # at most 2 * SAMPLE_DOCS rows
    short = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    found = short.join(F.broadcast(rows), "doc_id").select("doc_id", "text", "toxic")
    return found.orderBy("doc_id", "text").limit(2 * SAMPLE_DOCS)


def learn(docs: DataFrame, labels: DataFrame) -> Chain | None:
    rows = sample(docs, labels).collect()
    toxic = np.array([int(r.toxic == 1) for r in rows])
    if not toxic.any() or toxic.all():
        return None
    words = Words([r.text for r in rows])
    fold = np.zeros(len(rows), int)
    for y in (0, 1):  # rows come by doc_id, of which the label is independent
        fold[toxic == y] = np.arange((toxic == y).sum()) % FOLDS
    every = np.ones(len(rows), bool)
    seen = np.zeros((len(rows), 3))
    for k in range(FOLDS):
        rest = fold != k
        if rest.any() and (fold == k).any() and toxic[rest].any() and not toxic[rest].all():
            seen[fold == k] = judge(words, *fit_chain(words, toxic, rest), fold == k)
    weight, moves = fit_chain(words, toxic, every)
    if not seen.any(axis=1).all():  # too few rows to leave some out
        seen = judge(words, weight, moves, every)
    known = {f: float(w) for f, w in zip(words.names, weight[:-1].tolist(), strict=True) if abs(w) > 1e-3}
    return Chain(known, float(weight[-1]), moves, fit_curve(seen, toxic))


class Lookup(dict):
    """Word to log ratio; what was asked is remembered."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain = chain

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        self[word] = found = self.chain.token(word)
        return found


def spans(text: str, hot: np.ndarray) -> list[dict]:
    """Character offsets of runs of toxic tokens."""
    out: list[dict] = []
    previous = -2
    for k, m in enumerate(TOKEN.finditer(text)):
        if hot[k]:
            if k == previous + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            previous = k
    return out


def score(docs: DataFrame, chain: Chain | None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out (or the columns to keep), score, predicted and the offending spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def prepare() -> Callable:
        model = shared.value
        lookup = Lookup(model) if model else None

        def work(texts: list[str | None]) -> tuple[None, list]:
            if model is None:
                return None, [np.zeros(len(texts)), np.zeros(len(texts), np.int32), [[]] * len(texts)]
            tokens = [TOKEN.findall(t or "") for t in texts]
            lens = np.array([len(t) for t in tokens], np.int64)
            e = np.exp(np.fromiter((lookup[w] for t in tokens for w in t), np.float64, int(lens.sum())))
            found, p = evidence(e, lens, np.exp(model.moves))
            value = 1 / (1 + np.exp(-np.clip(found @ model.curve, -30, 30)))
            ends, marked = np.cumsum(lens), []
            for t, a, z in zip(texts, ends - lens, ends, strict=True):
                hot = p[a:z] >= 0.5
                marked.append(spans(t, hot) if hot.any() else [])
            return None, [value, (value >= 0.5).astype(np.int32), marked]

        return work

    made = "score double, predicted int, spans array<struct<start:int,end:int>>"
    if keep:
        return map_texts(docs, keep, prepare, made)
    rows = docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    return map_texts(rows, ["doc_id", "held_out"], prepare, made)


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
