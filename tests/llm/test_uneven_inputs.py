"""Repeated rows, long periodic texts and depleted documents."""

import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import kd_shards, line_quality, repeats


def test_shards_of_repeated_rows(spark):
    rows = [(None, "one text that many rows have " * 4)] * 5000 + [(k, f"text {k} " * (k % 9 + 1)) for k in range(2000)]
    out = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    total = sum(r.b for r in found)
    assert len(found) == kd_shards.SHARDS and sum(r.n for r in found) == len(rows)
    assert all(r.last + 1 == r.n == r.slots for r in found)
    assert all(abs(r.b - total / kd_shards.SHARDS) < 0.02 * total / kd_shards.SHARDS for r in found)


def cut(texts):
    """What is left of each text, window by window."""
    seen, out = set(), []
    for t in texts:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for w in range(len(raw) - repeats.LENGTH + 1):
            x = raw[w : w + repeats.LENGTH]
            gone[w : w + repeats.LENGTH] |= x in seen
            seen.add(x)
        out.append((len(raw), int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return out


def test_periodic_texts_equal_brute_force(spark):
    rng = random.Random(11)
    piece = lambda: rng.choice(["a" * rng.randrange(1, 900), "ab" * rng.randrange(1, 300), "xyz, " * rng.randrange(1, 90), "".join(rng.choices("abcdefgh", k=rng.randrange(1, 200))), "".join(rng.choices("pq", k=70)) * 4])
    parts = [piece() for _ in range(30)]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert len(got) == len(texts)
    for k, (n, gone, digest) in enumerate(cut(texts)):
        assert (got[k].n_bytes, got[k].n_removed, got[k].kept_sha256) == (n, gone, digest)


def test_a_repeated_character_is_quick():
    for unit in (b"a", b"ab"):
        raw, began = unit * (1_000_000 // len(unit)), time.time()
        assert len(repeats.runs(raw, repeats.periodic(np.frombuffer(raw, np.uint8)))) <= len(unit)
        assert time.time() - began < 2


def test_depleted_documents_go(spark):
    words = lambda k, n: " ".join("".join(chr(97 + int(c)) for c in str(k * 131 + j)) for j in range(n))
    line = "a line that every page of this host has in common with the others"
    rows = [(k, f"{line}\n{words(k, 45 if k < 5 else 80)}", "h") for k in range(60)]
    found = {r.doc_id: r for r in line_quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(r.base_failed for r in found.values()) and all(r.lost_words == len(line.split()) for r in found.values())
    assert [k for k, r in found.items() if not r.kept] == [k for k in found if k < 5]
