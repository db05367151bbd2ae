"""Operator 10: exact repeats by a depth-limited radix sort of suffixes.

Suffixes are compared by their first LENGTH bytes only; those that agree on all
of them are repeated windows. Ordering every suffix of a corpus would move it a
hundred times over, so the most significant digit is content-defined: of a
window, the GRAM-byte string with the least hash (leftmost of equals) and its
place. Equal windows have equal digits, and neighbouring windows share one.

0. Windows that equal one up to FAR places earlier in their text (runs of a
   character, short periods) are repeats at once; they need no digit.
1. Digit one, in the map: a row per run of windows with the same digit, carrying
   the gram's hash and the run's place. Runs of a batch that equal an earlier one
   byte for byte are repeats at once (a map-side combine, which takes the weight
   off passages that many documents share).
2. In the shuffle by gram, runs whose gram stands nowhere else are dropped.
3. The others fetch their bytes and meet by gram; for each place of the gram the
   windows are radix sorted, 8 bytes a pass, singles dropped after each pass.
   Windows left at LENGTH bytes are equal; all but the first are repeats.

A hash only brings windows together; bytes alone decide. Grams that one document
in SAMPLE shows OFTEN times (the HOTTEST of them) are hot: the map deals their
runs by whole windows at once, which equal windows alone share, so no task meets
all the runs of a hot gram. A gram with over MANY runs is dealt by a shorter
digit of its own when the bytes are fetched. Both choose the way, not the result.

The union of repeated windows is cut out of each document.

Defined cases: null text counts as empty (and stays null in the pipeline); texts
under LENGTH bytes lose nothing; repeated rows (equal doc_id and text) are one
document and get equal results; rows that share a doc_id but not a text are
documents each, in the order of a hash of the text; a null doc_id comes before
all others and stays null; of equal windows the earliest stays, ties by the
order named; very long texts are hashed block by block, whole; an empty table
gives an empty result; columns of docs may have any names in the pipeline, and
are not read in the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, materialize, partitions, table

LENGTH = 100
GRAM = 32
PRIME = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
#: Longest period of a stretch that is settled by comparing the text with itself.
FAR = 64
#: Window starts hashed at once.
BLOCK = 1 << 16
#: Bytes of run content sorted at once.
CHUNK = 16 << 20
#: A gram with more runs is cut into pieces of so many window starts.
MANY = 1000
PIECE = 8
#: Hot grams: found OFTEN times in one of SAMPLE documents; the HOTTEST at most are sent to the tasks.
SAMPLE = 64
OFTEN = 1024
HOTTEST = 100_000
#: Characters whose runs are compared in the map.
CHARS = 16_000_000


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h, n = b.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(PRIME, n, 1 << 64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    rest = width - n
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def periodic(b: np.ndarray) -> np.ndarray:
    """Whether each window of a text equals the one q places earlier, for a q up to FAR."""
    edge = np.zeros(max(len(b) - LENGTH, -1) + 2, np.int64)
    step, least = LENGTH // 4, 4  # a stretch of LENGTH bytes holds so many of every step-th place
    ahead = np.concatenate([b.astype(np.int16), np.full(FAR, -1, np.int16)])
    ahead = np.lib.stride_tricks.sliding_window_view(ahead, FAR + 1)[::step]
    likely = np.zeros(FAR, bool)
    for at in range(0, len(ahead) - least + 1, BLOCK // 4):
        hit = ahead[at : at + BLOCK // 4 + least - 1]
        hit = hit[:, 1:] == hit[:, :1]
        likely |= np.logical_and.reduce([hit[k : len(hit) - least + 1 + k] for k in range(least)]).any(axis=0)
    for q in (np.flatnonzero(likely) + 1).tolist():
        same = np.concatenate([[False], b[:-q] == b[q:], [False]])
        start, end = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).T
        long = end - start >= LENGTH
        np.add.at(edge, start[long] + q, 1)
        np.add.at(edge, end[long] + q - LENGTH + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def runs(raw: bytes, skip: np.ndarray) -> np.ndarray:
    """Rows (gram hash, first window, last window, gram's place) over all windows of a text but those to skip."""
    out = []
    b = np.frombuffer(raw, np.uint8)
    width = LENGTH - GRAM + 1
    for at in range(0, len(b) - LENGTH + 1, BLOCK):
        h = gram_hashes(b[at : at + BLOCK + LENGTH - 1])
        low = sliding_min(h, width)
        skipped = skip[at : at + len(low)]
        s0 = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (skipped[1:] != skipped[:-1])))
        s1 = np.append(s0[1:] - 1, len(low) - 1)
        s0, s1 = s0[~skipped[s0]], s1[~skipped[s0]]
        reach = np.arange(width)
        while len(s0):
            p = np.concatenate([s0[k : k + 4096] + h[s0[k : k + 4096, None] + reach].argmin(axis=1) for k in range(0, len(s0), 4096)])
            end = np.minimum(s1, p)  # past its gram, a window has the next of the equals
            out.append(np.stack([h[p].view(np.int64), s0 + at, end + at, p + at], axis=1))
            s0, s1 = p[s1 > p] + 1, s1[s1 > p]
    rows = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return rows[np.argsort(rows[:, 1], kind="stable")]


def first_digit(texts: list[str | None], d: pa.Array, t: pa.Array, hot: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Text positions, grams and places (see packed) of the runs of a batch, and of the repeats found in it (see decided)."""
    import xxhash

    docs, found, content = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)], []
    own = [np.zeros((0, 3), np.int64)]  # text, begin and end of stretches that repeat what stands a period earlier
    raws = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    for k, raw in enumerate(raws):
        skip = periodic(np.frombuffer(raw, np.uint8))
        if skip.any():
            padded = np.concatenate([[False], skip, [False]])
            begin, end = np.flatnonzero(padded[1:] != padded[:-1]).reshape(-1, 2).T
            own.append(np.stack([np.full(len(begin), k), begin, end - 1 + LENGTH], axis=1))
        r = runs(raw, skip)
        if len(hot) and len(r):
            split = np.isin(r[:, 0], hot)
            if split.any():
                n = r[split, 2] - r[split, 1] + 1
                start = np.repeat(r[split, 1] - np.cumsum(n) + n, n) + np.arange(n.sum())
                whole = np.array([xxhash.xxh3_64_intdigest(raw[x : x + LENGTH], 1) for x in start.tolist()], np.uint64).view(np.int64)
                r = np.concatenate([r[~split], np.stack([whole, start, start, np.repeat(r[split, 3], n)], axis=1)])
        docs.append(np.full(len(r), k, np.int64))
        found.append(r)
        content += [xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(r[:, 1].tolist(), (r[:, 2] + LENGTH).tolist(), strict=True)]
    docs, r, content = np.concatenate(docs), np.concatenate(found), np.array(content, np.uint64)
    by_id = np.lexsort((t.to_numpy(), d.to_numpy()))
    place = np.zeros(len(texts), np.int64)
    place[by_id] = np.arange(len(texts))
    order = np.lexsort((r[:, 3], place[docs], r[:, 1] - r[:, 3], content, r[:, 0]))
    docs, r, content = docs[order], r[order], content[order]
    same = np.append(False, (r[1:, 0] == r[:-1, 0]) & (content[1:] == content[:-1]) & (r[1:, 1] - r[1:, 3] == r[:-1, 1] - r[:-1, 3]))[: len(r)]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(r))))
    twin = np.zeros(len(r), bool)
    for k in np.flatnonzero(same).tolist():  # equal hashes: the bytes decide
        f = first[k]
        twin[k] = raws[docs[k]][r[k, 1] : r[k, 2] + LENGTH] == raws[docs[f]][r[f, 1] : r[f, 2] + LENGTH]
    d, t = d.to_numpy()[docs], t.to_numpy()[docs]
    itself = (d == d[first]) & (t == t[first]) & (r[:, 3] == r[first, 3]) & (r[:, 1] == r[first, 1])  # a repeated row
    gone, left = twin & ~itself, ~twin
    spot = (r[left, 3] << 14) | (r[left, 3] - r[left, 1] << 7) | (r[left, 3] - r[left, 2])
    own = np.concatenate(own)
    at, a, z = touching(np.concatenate([docs[gone], own[:, 0]]), np.concatenate([r[gone, 1], own[:, 1]]), np.concatenate([r[gone, 2] + LENGTH, own[:, 2]]))
    mark = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in np.stack([at, a], axis=1)], np.uint64).view(np.int64)  # deals them out
    return np.concatenate([docs[left], at]), [np.concatenate([r[left, 0], mark]), np.concatenate([spot, ~(a << 32 | z - a)])]


def touching(docs: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of a document made one."""
    order = np.lexsort((a, docs))
    docs, a, z = docs[order], a[order], z[order]
    if not len(docs):
        return docs, a, z
    start = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (a[1:] > z[:-1])))  # runs of a document are in order, so ends rise
    return docs[start], a[start], z[np.append(start[1:] - 1, len(docs) - 1)]


def digits(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """_d, _t, gram, at: at is place << 14 | lead << 7 | tail of a run, or ~(start << 32 | length) of a stretch of repeats."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def prepare() -> Callable:
        known = shared.value
        return lambda found, d, t: first_digit(found, d, t, known)

    return map_texts(texts.where(F.octet_length("text") >= LENGTH), ["_d", "_t"], prepare, "gram long, at long", ("_d", "_t"), CHARS)


def hot_grams(texts: DataFrame) -> np.ndarray:
    some = texts.where(F.pmod(F.xxhash64("_d", "_t"), F.lit(SAMPLE)) == 0)
    seen = digits(some, np.zeros(0, np.int64)).where("at >= 0").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = seen.where(F.col("n") >= OFTEN).orderBy(F.desc("n")).limit(HOTTEST).collect()
    return np.array(sorted(r.gram for r in found), np.int64)


def same_windows(groups: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Radix sort of LENGTH-byte rows within groups, earlier rows first; True where an equal row came earlier."""
    words = np.zeros((len(windows), -(-LENGTH // 8) * 8), np.uint8)
    words[:, :LENGTH] = windows
    words = words.view("<u8")
    rows, group = np.arange(len(windows)), groups
    for k in range(words.shape[1]):
        order = np.lexsort((words[rows, k], group))
        rows, group = rows[order], group[order]
        w = words[rows, k]
        fresh = np.append(True, (group[1:] != group[:-1]) | (w[1:] != w[:-1]))[: len(rows)]
        group = np.cumsum(fresh)
        alone = fresh & np.append(fresh[1:], True)[: len(rows)]
        rows, group = rows[~alone], group[~alone]
        if not len(rows):
            break
    out = np.zeros(len(windows), bool)
    if len(rows):
        lead = np.append(True, group[1:] != group[:-1])
        out[rows[~lead]] = True
    return out


def _sort_group(b: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The stretch of each run that repeated windows cover; the runs with a window that repeats none."""
    b = b.sort_values(["gram", "d", "t", "place", "lead"], kind="stable", ignore_index=True)
    key = b[["gram", "d", "t", "place", "lead"]].to_numpy(np.int64)  # repeated rows brought their runs along
    b = b[np.append(True, (key[1:] != key[:-1]).any(axis=1))[: len(b)]].reset_index(drop=True)
    twin = b.duplicated(["gram", "lead", "tail", "raw"]).to_numpy()  # equal runs, byte for byte: all their windows repeat
    same, b = b[twin], b[~twin].reset_index(drop=True)
    same = pd.DataFrame({"d": same["d"], "t": same["t"], "a": same["place"] - same["lead"], "z": same["place"] - same["tail"] + LENGTH})
    lead, tail, gram = b["lead"].to_numpy(np.int64), b["tail"].to_numpy(np.int64), b["gram"].to_numpy()
    raw = b["raw"].tolist()
    buf = np.frombuffer(b"".join(raw) + bytes(LENGTH), np.uint8)
    size = np.array([len(x) for x in raw], np.int64)
    start = np.cumsum(size) - size
    most, least, repeated = np.full(len(b), -1), np.full(len(b), LENGTH), np.zeros(len(b), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)
    for o in range(LENGTH - GRAM + 1):  # windows that begin o bytes before the gram
        idx = np.flatnonzero((lead >= o) & (tail <= o))
        if len(idx) < 2:
            continue
        g = gram[idx]
        twin = np.append(False, g[1:] == g[:-1]) | np.append(g[1:] == g[:-1], False)
        idx = idx[twin]
        if not len(idx):
            continue
        again = idx[same_windows(gram[idx], view[start[idx] + lead[idx] - o])]
        most[again] = np.maximum(most[again], o)
        least[again] = np.minimum(least[again], o)
        repeated[again] += 1
    hit = most >= 0
    place = b["place"].to_numpy()[hit]
    found = pd.DataFrame({"d": b["d"].to_numpy()[hit], "t": b["t"].to_numpy()[hit], "a": place - most[hit], "z": place - least[hit] + LENGTH})
    return pd.concat([same, found]), b[repeated < lead - tail + 1]


def _by_gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by gram, document and place.

    Complete groups are sorted and let go. A group that outgrows CHUNK keeps only
    the runs with a window not seen before: all that later rows can repeat.
    """
    held: list[pd.DataFrame] = []
    size, limit = 0, CHUNK
    for b in batches:
        for at in range(0, len(b), 20_000):
            part = b.iloc[at : at + 20_000]
            held.append(part)
            size += int(part["lead"].sum() - part["tail"].sum()) + LENGTH * len(part)
            if size < limit:
                continue
            every = pd.concat(held, ignore_index=True)
            over = every["gram"] != every["gram"].iloc[-1]
            if over.any():
                yield _sort_group(every[over])[0]
                every, limit = every[~over], CHUNK
            else:
                found, every = _sort_group(every)
                yield found
            held = [every]
            size = int(every["lead"].sum() - every["tail"].sum()) + LENGTH * len(every)
            limit = max(limit, 2 * size)
    if held:
        yield _sort_group(pd.concat(held, ignore_index=True))[0]


def _with_bytes(texts: list[str], found: pa.Array, *rest: pa.Array) -> tuple[list[int], list[list]]:
    """The bytes of each asked run; of a gram with many runs, cut into pieces of PIECE window starts.

    All windows of a piece contain its core, so equal windows have equal cores:
    the next digit, by which such a gram falls apart before it meets in a task.
    """
    import xxhash

    out = []
    for k, (text, asks) in enumerate(zip(texts, found.to_pylist(), strict=True)):
        raw = text.encode("utf-8", "surrogatepass")
        for x in asks:
            gram, p, lead, tail = x["gram"], x["at"] >> 14, x["at"] >> 7 & 127, x["at"] & 127
            if x["n"] <= MANY:
                out.append((k, gram, p, lead, tail, raw[p - lead : p - tail + LENGTH]))
                continue
            for j in range(tail // PIECE, lead // PIECE + 1):
                far, near = min(lead, j * PIECE + PIECE - 1), max(tail, j * PIECE)
                core = raw[p - j * PIECE : p - j * PIECE - PIECE + 1 + LENGTH]
                key = xxhash.xxh3_64_intdigest(core, j) - (1 << 63)
                out.append((k, key, p, far, near, raw[p - far : p - near + LENGTH]))
    return [r[0] for r in out], [[r[k] for r in out] for k in range(1, 6)]


def joined(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching (start, end) rows made one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:] - 1, len(spans) - 1)]], axis=1)


def cut_out(raw: bytes, spans: np.ndarray) -> bytes:
    at, parts = 0, []
    for a, z in spans.tolist():
        parts.append(raw[at:a])
        at = z
    return b"".join([*parts, raw[at:]])


def keyed(docs: DataFrame) -> DataFrame:
    """docs, text never null, with _none (it was) and what orders and tells documents apart: _d, _t."""
    d = F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long")
    t = F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())
    return docs.withColumns({"_d": d, "_t": t, "_none": F.col("text").isNull(), "text": F.coalesce("text", F.lit(""))})


def repeated_spans(given: DataFrame, texts: DataFrame) -> DataFrame:
    """_d, _t, spans array<struct<a,z>> of the repeats in keyed rows; texts are the same, dealt by _d and _t."""
    n = partitions(texts.sparkSession)
    slim = given.select("_d", "_t", "text")
    rows = digits(slim, hot_grams(slim))
    count = F.count(F.when(F.col("at") >= 0, 1)).over(Window.partitionBy("gram"))
    rows = rows.withColumn("n", count)
    stretch = F.bitwise_not("at")
    start = F.shiftright(stretch, 32)
    decided = F.when(F.col("at") < 0, F.struct(start.alias("a"), (start + stretch.bitwiseAND(0xFFFFFFFF)).alias("z")))
    asks = F.when((F.col("at") >= 0) & (F.col("n") > 1), F.struct("gram", "at", "n"))
    told = rows.select("_d", "_t", decided.alias("decided"), asks.alias("asks")).where("decided is not null or asks is not null")
    told = told.groupBy("_d", "_t").agg(F.collect_list("decided").alias("decided"), F.collect_set("asks").alias("found"))
    told = materialize(told, "repeats")
    asked = texts.join(told.where(F.size("found") > 0).select("_d", "_t", "found"), ["_d", "_t"])
    rest = [c for c in texts.columns if c not in ("_d", "_t", "text")]  # with the same columns as the result, the texts are shuffled once
    content = map_texts(asked, ["_d", "_t"], lambda: _with_bytes, "gram long, place long, lead int, tail int, raw binary", ("found", *rest))
    content = content.withColumnsRenamed({"_d": "d", "_t": "t"})
    late = content.repartition(n, "gram").sortWithinPartitions("gram", "d", "t", "place", "lead").mapInPandas(_by_gram, "d long, t long, a long, z long")
    late = late.groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("a", "z")).alias("late"))
    spans = told.select("_d", "_t", "decided").join(late, ["_d", "_t"], "full_outer")
    empty = F.expr("cast(array() as array<struct<a:bigint,z:bigint>>)")
    return spans.select("_d", "_t", F.concat(F.coalesce("decided", empty), F.coalesce("late", empty)).alias("spans"))


def remove_repeats(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    With keep: those columns of docs, the text being what is kept (bytes of a
    character that was cut in two are dropped); none of them may begin with _d, _t.
    """
    columns = list(dict.fromkeys(["doc_id", "text", *(keep or ())]))
    given = keyed(docs.select(*columns))
    texts = given.repartition(partitions(docs.sparkSession), "_d", "_t")
    spans = repeated_spans(given, texts)
    made = "kept string" if keep else "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def work(given: list[str], found: pa.Array, none: pa.Array) -> tuple[None, list]:
        out = []
        for text, f, nothing in zip(given, found.to_pylist(), none.to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            s = joined(np.array([(x["a"], x["z"]) for x in f or ()], np.int64).reshape(-1, 2))
            kept = cut_out(raw, s)
            out.append((None if nothing else kept.decode("utf-8", "ignore"),) if keep else (len(raw), len(raw) - len(kept), len(s), hashlib.sha256(kept).hexdigest()))
        return None, [[r[k] for r in out] for k in range(1 if keep else 4)]

    rest = [c for c in columns if c != "text"] if keep else ["doc_id"]
    out = map_texts(texts.join(spans, ["_d", "_t"], "left"), rest, lambda: work, made, ("spans", "_none"))
    return out.withColumnRenamed("kept", "text").select(*keep) if keep else out


def op10_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
