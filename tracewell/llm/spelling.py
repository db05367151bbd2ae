"""Operator 12: spelling variants by PartEnum signatures of letter multisets.

Two words one insertion, deletion or replacement apart have letter multisets that
differ in one or two letters: as binary vectors (an n-th copy of a letter is one
dimension) they lie within Hamming distance 2.

1. Partition: the letters are dealt into PARTS parts. Vectors within distance 2
   differ in at most 2 parts.
2. Enumerate: a word has one signature for each pair of parts left out, an exact
   hash of its letters in all other parts. Near words share at least one.
3. Equi-join: the words of a signature meet in one task. No pairs are made of them
   as such: of two near words either the first or the last half of the shorter one
   is whole in both, so inside a signature only words with an equal half are
   compared.
4. Verify: the common beginning and the common end together reach the longer word's
   length less one. A pair counts in one signature only, the one that leaves out
   the parts of its differing letters (and the first other part, if that is one).

A word's form is its near word of largest count, if that is RATIO times its own or
more; its root is found by following forms. Counts grow RATIO times a step, so the
chains are short, and pointers are doubled each round.

Defined cases: a null text has no words; a null doc_id counts as the empty text;
repeated rows are counted each; of near words with equal counts the form is the
smallest in code-point order; words of any length are compared whole (those over
WIDE letters one by one); an empty table gives an empty result; other columns of
docs are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import materialize, partitions, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
#: One occurrence in so many, by hash, loses a letter.
DAMAGED = 31
PARTS = 6
LEFT_OUT = tuple(combinations(range(PARTS), 2))
#: Letters of a word compared in columns; longer words are compared one by one.
WIDE = 32
_RNG = np.random.default_rng(12)
#: A random number for each code point up to U+00FF, and for each place of a word.
OF_LETTER = _RNG.integers(0, 1 << 64, 256, np.uint64)
OF_PLACE = _RNG.integers(0, 1 << 64, WIDE, np.uint64) | np.uint64(1)
#: Part of each code point; letters next to one another in the alphabet go to different parts.
PART = np.arange(256) % PARTS


def runs(docs: DataFrame) -> DataFrame:
    """word: every occurrence, lower-cased, a letter deleted where the hash says so."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = F.regexp_extract_all("text", F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % MIN_LETTERS), F.lit(0))
    each = docs.where("text is not null").select(id_text.alias("id"), F.explode(found).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    each = each.select("id", low.alias("run"))
    each = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    each = each.select("run", "h", at.alias("at"))
    return each.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of MIN_LETTERS letters and MIN_COUNT occurrences or more."""
    counted = runs(docs).where(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in one array, and the words' lengths."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return codes, np.fromiter(map(len, words), np.int64, len(words))


def signatures(words: list[str]) -> np.ndarray:
    """One row of signatures for each word, in the order of LEFT_OUT."""
    codes, size = letters(words)
    row = np.repeat(np.arange(len(words)), size)
    part = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(part, (row, PART[codes]), OF_LETTER[codes])
    whole = part.sum(axis=1, dtype=np.uint64)
    out = np.stack([(whole - part[:, a] - part[:, b]) * np.uint64(2 * k + 1) + OF_LETTER[k] for k, (a, b) in enumerate(LEFT_OUT)], axis=1)
    return out.view(np.int64)


def signed(words: DataFrame) -> DataFrame:
    """(k, signature, word, n): a row for each word and pair of parts left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                sig = signatures(part.column(0).to_pylist())
                at = pa.array(np.repeat(np.arange(part.num_rows), len(LEFT_OUT)))
                k = pa.array(np.tile(np.arange(len(LEFT_OUT), dtype=np.int32), part.num_rows))
                yield pa.RecordBatch.from_arrays([k, pa.array(sig.ravel()), part.column(0).take(at), part.column(1).take(at)], ["k", "signature", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "k int, signature long, word string, n long")


def pairs_of_groups(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of equal keys, each pair once, a distance in the sorted keys at a time."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.arange(len(key))
    for d in range(1, len(key)):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            return
        yield order[at], order[at + d]


def one_apart(a: str, b: str) -> int:
    """The place of the single difference between two words; -1 if there is another number of them."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return -1
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return p if a[p + 1 :] == b[p + 1 :] else -1
    return p if (a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p:]) else -1


def left_out_at(parts_a: np.ndarray, parts_b: np.ndarray) -> np.ndarray:
    """Where in LEFT_OUT the parts of two differing letters are; equal parts go with the first other part."""
    low, high = np.minimum(parts_a, parts_b), np.maximum(parts_a, parts_b)
    same = low == high
    other = np.where(low == 0, 1, 0)
    low, high = np.where(same, np.minimum(low, other), low), np.where(same, np.maximum(high, other), high)
    place = np.full((PARTS, PARTS), -1)
    for k, (a, b) in enumerate(LEFT_OUT):
        place[a, b] = k
    return place[low, high]


def near_pairs(group: np.ndarray, k: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of words one edit apart; group: equal for rows of a signature, k: its place in LEFT_OUT."""
    codes, size = letters(words.tolist())
    first = np.concatenate([[0], np.cumsum(size)])
    fits = np.flatnonzero(size <= WIDE)
    rows, row_len = np.repeat(np.arange(len(fits)), size[fits]), size[fits]
    col = np.arange(len(rows)) - np.repeat(np.cumsum(row_len) - row_len, row_len)
    flat = codes[np.repeat(first[fits], row_len) + col].astype(np.uint8)
    left, right = np.zeros((len(fits), WIDE), np.uint8), np.zeros((len(fits), WIDE), np.uint8)
    left[rows, col] = flat
    right[rows, np.repeat(row_len, row_len) - 1 - col] = flat
    here = np.arange(len(fits))
    halves = {side: np.concatenate([np.zeros((len(fits), 1), np.uint64), np.cumsum((OF_LETTER[m] * OF_PLACE).astype(np.uint64), axis=1, dtype=np.uint64)], axis=1) for side, m in enumerate((left, right))}
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for side in (0, 1):
        # a word is the shorter one of a pair (or as long), or one letter longer
        short = np.concatenate([row_len, row_len - 1])
        longer = np.repeat([False, True], len(fits))
        at = np.concatenate([here, here])
        half = halves[side][at, short // 2]
        mixed = (group[fits[at]].view(np.uint64) * OF_PLACE[0] + short.astype(np.uint64)) * OF_PLACE[1] + half
        for x, y in pairs_of_groups(mixed):
            ok = ~(longer[x] & longer[y])
            i, j = at[x[ok]], at[y[ok]]
            ok = (group[fits[i]] == group[fits[j]]) & (i != j)
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 1 << 16):
                found.append(_checked(i[s : s + (1 << 16)], j[s : s + (1 << 16)], left, right, row_len, k[fits], side))
    i = np.concatenate([np.zeros(0, int), *[a for a, _ in found]])
    j = np.concatenate([np.zeros(0, int), *[b for _, b in found]])
    i, j = fits[i], fits[j]
    far = _long_pairs(group, k, words, size)
    return np.concatenate([i, far[:, 0]]), np.concatenate([j, far[:, 1]])


def _checked(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray, k: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j) those one edit apart that belong to this signature and, if both halves are whole, to the first side."""
    a, b = size[i], size[j]
    differ, behind = left[i] != left[j], right[i] != right[j]
    p = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDE)
    s = np.where(behind.any(axis=1), behind.argmax(axis=1), WIDE)
    p, s = np.minimum(p, np.minimum(a, b)), np.minimum(s, np.minimum(a, b))
    half = np.minimum(a, b) // 2
    ok = (np.abs(a - b) <= 1) & (p + s >= np.maximum(a, b) - 1) & ((a != b) | (p < a)) & ((side == 0) | (p < half))
    i, j, p, a, b = i[ok], j[ok], p[ok], a[ok], b[ok]
    in_i = PART[left[i, np.minimum(p, WIDE - 1)]]
    in_j = PART[left[j, np.minimum(p, WIDE - 1)]]
    in_i, in_j = np.where(a < b, in_j, in_i), np.where(b < a, in_i, in_j)
    own = left_out_at(in_i, in_j) == k[i]
    return i[own], j[own]


def _long_pairs(group: np.ndarray, k: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of near pairs with a word of over WIDE letters."""
    at = np.flatnonzero(size >= WIDE)
    out = []
    of: dict[tuple, list[int]] = {}
    for r in at.tolist():
        w, n = words[r], int(size[r])
        for short in (n, n - 1):
            for side, half in ((0, w[: short // 2]), (1, w[n - short // 2 :])):
                of.setdefault((int(group[r]), short, side, half), []).append(r)
    for (_, short, side, half), rows in of.items():
        for x, r in enumerate(rows):
            for q in rows[:x]:
                a, b = words[r], words[q]
                if max(len(a), len(b)) <= WIDE or len(a) == len(b) == short + 1:
                    continue
                p = one_apart(a, b)
                if p < 0 or (side == 1 and p >= short // 2):
                    continue
                parts = [PART[ord(w[p])] for w in (a, b) if p < len(w) and len(w) == max(len(a), len(b))]
                if left_out_at(np.array(parts[:1]), np.array(parts[-1:]))[0] == k[r]:
                    out.append((r, q))
    return np.array(out, np.int64).reshape(-1, 2)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words one edit apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def work(b: pd.DataFrame) -> pd.DataFrame:
            mixed = b["signature"].to_numpy(np.int64)
            w, n = b["word"].to_numpy(object), b["n"].to_numpy(np.int64)
            i, j = near_pairs(mixed, b["k"].to_numpy(), w)
            return pd.DataFrame({"word": np.concatenate([w[i], w[j]]), "near": np.concatenate([w[j], w[i]]), "near_n": np.concatenate([n[j], n[i]])})

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            sig = b["signature"].to_numpy()
            cut = int(np.searchsorted(sig, sig[-1])) if len(b) else 0
            if cut:
                yield work(b.iloc[:cut])
            rest = b.iloc[cut:]
        if rest is not None and len(rest):
            yield work(rest)

    dealt = signed(words).repartition(partitions(words.sparkSession), "signature").sortWithinPartitions("signature")
    return dealt.mapInPandas(run, "word string, near string, near_n long")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    words = materialize(vocabulary(docs), "vocabulary")
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("c"), F.col("near").alias("w")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = F.col("best.near_n") >= RATIO * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best.near_n")).alias("form_n")
    )
    out = materialize(out, "forms")
    return out.join(roots(out.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) without cycles: each round halves the steps that are left."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def op12_partenum_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


#: crc32 is taken byte by byte from a table of its 256 values, near words from texts with one letter open.
ORACLE_SQL = """
with recursive bits as (
  select range as b, 0 as k, range::ubigint as c from range(256)
  union all
  select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from bits where k < 8),
tab as materialized (select list(c order by b) as t from bits where k = 8),
low as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{00C0}-\\x{00FF}]+')) as w
  from documents where text is not null),
keyed as materialized (
  select w, doc_id || ':' || w as s, count(*) as m from low where length(w) >= 7 group by all),
crc as materialized (
  select w, m, xor(4294967295::ubigint, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(range(0, octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::ubigint)),
    lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)::int]))) as h
  from keyed, tab),
fixed as (
  select case when h % 31 = 0 then left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, m from crc),
v as materialized (
  select word, sum(m)::bigint as n from fixed where length(word) >= 7 group by word having sum(m) >= 2),
gaps as materialized (
  select word, n, left(word, i::int) as a, substr(word, i::int + 2) as b from v, lateral (select unnest(range(0, length(word))) as i)),
pairs as (
  select x.word, y.word as near, y.n as near_n from gaps x join gaps y on x.a = y.a and x.b = y.b and x.word <> y.word
  union
  select x.word, v.word, v.n from gaps x join v on v.word = x.a || x.b
  union
  select v.word, x.word, x.n from gaps x join v on v.word = x.a || x.b),
best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by word),
f as materialized (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n
  from v left join best using (word)),
walk as (
  select word, word as here, 0 as k from f
  union all
  select walk.word, f.form, k + 1 from walk join f on f.word = walk.here where f.form is not null)
select f.word, f.n, f.n_near, f.form, f.form_n, r.root
from f join (select word, arg_max(here, k) as root from walk group by word) r using (word)
"""
