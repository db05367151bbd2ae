"""The near-duplicate stage against brute force on similarity."""

import random

import corpus_pipeline
from tracewell.llm import near_copies
from tracewell.llm.common import table

SF = "/root/testdata/sf0.001"


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    """Positions that share a component, each with the least."""
    sets, root = [five(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(rows))]


def replaced(text, one_in, rng):
    return " ".join(f"z{rng.random()}" if rng.random() < 1 / one_in else w for w in text.split())


def test_stage_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    long = [t for _, t in docs if t and 100 <= len(t.split()) <= 2000][:30]
    rows = docs + [(10_000 + 100 * k + n, replaced(t, n, rng)) for k, t in enumerate(long) for n in (25, 60, 99)]
    rows += [(20_000 + k, replaced(long[0], 45, rng)) for k in range(60)]  # a group around one text
    rows += [(30_000, ""), (30_001, None), (30_002, "two words"), (30_003, "TWO  words")]
    roots = brute_force(rows)
    want = sorted(rows[k][0] for k in set(roots))
    assert len(want) < len(rows) - 60
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, given, SF).collect())
    assert got == want


def test_null_and_shared_ids_are_rows(spark):
    words = [" ".join(f"{a}{k}" for k in range(80)) for a in "abcd"]
    rows = [(None, words[0]), (None, words[0]), (7, words[1]), (7, words[2]), (3, words[3]), (None, words[3])]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text[0], r.doc_id) for r in got) == [("a", None), ("b", 7), ("c", 7), ("d", 3)]


def test_chain_and_near_misses_in_large_buckets(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(150)]
    rows, now = [], list(words)
    for k in range(60):  # each alike to its neighbours of the chain only
        rows.append((k, " ".join(now)))
        for i in range(3):
            now[(3 * k + i) % 150] = f"c{k}.{i}"
    for k in range(60):  # around one text, on both sides of the limit
        rows.append((1000 + k, replaced(" ".join(f"v{i}" for i in range(150)), rng.choice((18, 30, 60)), rng)))
    want = sorted(rows[k][0] for k in set(brute_force(rows)))
    assert 1 < len(want) < 60
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.keep_one(given).collect()) == want


def test_batches_of_linked_groups(spark):
    """Groups that the first step links whole, over several Arrow batches: nothing is left to compare."""
    rows = []
    for g in range(900):
        words = [f"g{g}w{k}" for k in range(61)]
        rows += [(g * 12 + k, " ".join([*words[:-1], f"end{k}"])) for k in range(12)]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {g * 12 for g in range(900)}


def test_shared_ids_are_settled_by_text(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base + " one"), (1, base + " two"), (1, base + " three")]
    kept = {near_copies.keep_one(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string").repartition(n)).first().text for k in range(3) for n in (1, 3)}
    assert len(kept) == 1


def test_gray_index_gives_the_first_candidates(spark, monkeypatch):
    """Operator 9's fingerprints and index: every text with another within its 2 bits gets a partner within them, and the stage asks them."""
    from tracewell.llm.simhash import DISTANCE, fingerprint

    rng = random.Random(3)
    docs = [t for (t,) in table(spark, SF, "documents").select("text").collect() if t and len(t.split()) > 150][:40]
    rows = [(n, t) for n, t in enumerate(x for d in docs for x in [d, *(replaced(d, one_in, rng) for one_in in (300, 150, 150))])]
    given = spark.createDataFrame(rows, "_row long, text string").repartition(3)
    made = near_copies.sketches(given).collect()
    assert {r.print % (1 << 64) for r in made} == {fingerprint(t) for _, t in rows}
    prints = {r.node: r.print for r in made}
    apart = lambda x, y: bin((prints[x] ^ prints[y]) % (1 << 64)).count("1")
    pairs = near_copies.gray_pairs(spark.createDataFrame(list(prints.items()), "node long, print long")).collect()
    assert all(apart(r.u, r.v) <= DISTANCE and r.u < r.v for r in pairs)
    want = {x for x in prints for y in prints if x != y and apart(x, y) <= DISTANCE}
    assert len(want) > 20
    assert {x for r in pairs for x in r} == want
    asked = []
    monkeypatch.setattr(near_copies, "gray_pairs", lambda nodes, f=near_copies.gray_pairs: asked.append(1) or f(nodes))
    roots = {r["_row"]: r.root for r in near_copies.near_copies(given).collect()}
    want = brute_force(rows)
    assert asked
    assert all((roots[x] == roots[y]) == (want[x] == want[y]) for x in roots for y in roots)


def test_stage_leaves_its_rows_and_what_it_kept_only(spark):
    from tracewell.llm import common

    given = spark.createDataFrame([(k, " ".join(f"w{i + k // 3}" for i in range(60))) for k in range(30)], "doc_id long, text string")
    with common.scratch(spark):
        kept = near_copies.keep_one(given)
        assert sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._written) == ["kept", "rows"]
        assert {r.doc_id for r in kept.collect()} <= set(range(0, 30, 3))
