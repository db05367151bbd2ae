"""Syncmer fingerprints, spelling variants and periodic runs against plain loops, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import periodic_runs, spelling, syncmers

SCHEMA = "doc_id long, text string, word string, begin long, near string, n long"
PLAIN = random.Random(5)
WORDS = ["abalone", "abalones", "abalona", "balonea", "straße", "Straßen", "strassen", "ÀÉÎõü", "x" * 40, "x" * 41, "x" * 39 + "y", "Quicksand", "quicksands", "quiksand", "kuicksand"]


def rows() -> list[tuple]:
    texts = [" ".join(PLAIN.choices(WORDS, [9] * 3 + [1] * 12, k=PLAIN.randrange(1, 60))) for _ in range(150)]
    texts += [None, "", " \n\t ", "one", "one two three four", "a b " * 300, "solo " * 50, "\x1c\x85 odd\x0bspaces İstanbul", " ".join(f"w{k * k % 997}" for k in range(20_000))]
    texts += ["the same text of several words for several rows " * 3] * 12
    out = [(k * 3, t, "w", 1, "n", 2) for k, t in enumerate(texts)]
    return [*out, (None, "no id here at all but six words", "w", 1, "n", 2), (None, "no id here at all but six words", "w", 1, "n", 2), (6, "an id twice, an id twice, an id twice, an id twice", "w", 1, "n", 2)]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def runs_by_loops(words: list[str]) -> list[tuple]:
    n, out = len(words), []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words])
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        at = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(at[::2].tolist(), at[1::2].tolist(), strict=True):
            length = b - a + q
            if length >= max(12, 2 * q) and not any(q % p == 0 and words[a : a + length - p] == words[a + p : a + length] for p in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_periodic_runs(docs):
    found = periodic_runs.periodic_runs(docs).collect()
    wanted = Counter()
    for doc_id, text, *_ in ROWS:
        words = split(text)
        h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_by_loops(words) if n < 2000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        wanted[doc_id, len(runs), *best, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept))] += 1
    long_id = next(r[0] for r in ROWS if len(split(r[1])) >= 2000)
    assert Counter(tuple(r) for r in found if r.doc_id != long_id) == wanted and len(found) == len(ROWS)


def test_runs_of_small_alphabets():
    rng = np.random.default_rng(3)
    for n in (2, 13, 40, 90, 200):
        for letters in (1, 2, 3):
            for _ in range(15):
                s = rng.integers(0, letters, n)
                got = [tuple(r) for r in periodic_runs.runs(s).tolist()]
                assert got == runs_by_loops([str(x) for x in s])


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_spelling_variants(docs):
    count = Counter()
    for doc_id, text, *_ in ROWS:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    vocab = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    wanted, form = {}, {}
    for w, n in vocab.items():
        near = [v for v in vocab if one_edit(v, w)]
        best = min(near, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if near and vocab[best] >= 10 * n else None
        wanted[w] = (n, len(near), form[w], vocab[best] if form[w] else None)
    found = {r.word: r for r in spelling.variants(docs).collect()}
    assert found.keys() == vocab.keys() and any(form.values())
    for w, r in found.items():
        root = w
        while form[root]:
            root = form[root]
        assert (r.n, r.n_near, r.form, r.form_n, r.root) == (*wanted[w], root)


def test_syncmers(spark, docs):
    found = syncmers.fingerprinted(docs).collect()
    # in the order of ids, null last; rows of one id by the hash of their text
    keyed = spark.createDataFrame(ROWS, SCHEMA).selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))
    wanted = Counter()
    for k, r in enumerate(order):
        ahead, n = order[(k + 1) % len(order)].text, len(r.text)
        text = r.text[: n - n // 4] + ahead[: n // 4]
        wanted[r.doc_id, n, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == wanted
    prints = {}
    text_of = {r.doc_id: r.text for r in order if r.doc_id not in (None, 6)}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) % 8 == 0
        if r.doc_id in text_of:
            assert prints.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
            assert bool(r.fingerprint) == bool(split(text_of[r.doc_id]))
            if r.edited_fingerprint == r.fingerprint:
                assert r.near_edited == 1
    long = next(r for r in found if r.n_chars > 50_000)
    assert long.near_edited > 0.5 > long.near_next
    anchors, words = len(long.fingerprint) / 8, 20_000
    assert words / (syncmers.K - syncmers.S + 1) - 1 <= anchors <= words * 0.8


def test_anchors_are_context_free(spark):
    core = " ".join(f"c{k}" for k in range(200))
    df = spark.createDataFrame([(1, core), (2, "left words here " + core + " right words"), (3, "z " * 40 + core)], "doc_id long, text string")
    got = {r.doc_id: r.a for r in syncmers.with_anchors(df, "text", "a").select("doc_id", "a").collect()}
    inner = ",".join(map(str, got[1]))
    assert all(inner in ",".join(map(str, got[k])) for k in (2, 3))


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(4, "eight code points and some more words in all")], "doc_id long, text string")
    r = syncmers.fingerprinted(one).first()
    assert r.near_next == 1 and 0 <= r.near_edited <= 1
    none = one.where("false")
    assert syncmers.fingerprinted(none).isEmpty() and spelling.variants(none).isEmpty() and periodic_runs.periodic_runs(none).isEmpty()
