"""The ten operators against brute force, round trips and held-out rows, odd rows included."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import bpe, components, kd_shards, language_id, line_quality, media_fingerprint, packing, repeats, simhash, toxicity, url_rules
from tracewell.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
PASSAGE = "the quick passage that several documents share goes on for rather more than one hundred bytes, as it must; "
ODD = [
    (1, PASSAGE * 2 + "one", "en", "a", 1), (2, "two " + PASSAGE, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 0),
    (6, "Ünïcode İstanbul ΣΑΣ it's 12 <|endoftext|> don't \u00a0 \u2028 e\u0301", "de", "b", 1), (7, LONG, "fr", "c", 2), (8, PASSAGE * 2 + "one", "en", "a", 1),
    (9, "a" * 700, "en", "c", 1), (10, "one two", "en", "a", 3), (11, "x\ny\nx\n" * 40, "es", "a", 3), (12, "\x1c\x85 odd\x0bspaces", "en", "a", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, fp long"


@pytest.fixture(scope="module")
def odd(spark):
    extra = [F.lit(k).alias(c) for k, c in enumerate(("size", "gram", "n_bytes", "score", "kept", "_lines", "shard", "length"))]
    return spark.createDataFrame(ODD, SCHEMA).select("*", *extra).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return dict(docs.select("doc_id", "text").collect()) | {}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_line_quality(spark, odd):
    found = by_id(line_quality.line_quality(odd))
    assert len(found) == len(ODD) and found[3].n_words == 0 and found[3].base_failed and not found[3].kept
    w = ODD[10][1].split()
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    assert found[11].n_repeat_words == len(hit) and found[11].n_dup_lines == 118
    assert found[12].n_words == 3  # only ASCII spaces divide words
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k * 7919))  # noqa: E731  digits would be folded
    own = "\n".join(f"own words of this document come here {{}} {k} " + " ".join(f"v{{}}q{k}r{j}" for j in range(10)) for k in range(6))
    rows = [(k, "Common   LINE of the host\n" + own.replace("{}", name(k)), "en", "h", 1) for k in range(40)]
    rows += [(100 + k, own.replace("{}", "copied"), "en", "h", 1) for k in range(30)]
    many = spark.createDataFrame(rows, SCHEMA)
    verdicts = line_quality.line_quality(many)
    seen = by_id(verdicts)
    assert all(list(seen[k].removed) == [0] and seen[k].kept for k in range(40))
    assert all(len(seen[100 + k].removed) == 6 and not seen[100 + k].kept for k in range(30))  # every copy is a document
    verdicts = line_quality.line_quality(many, once_per_text=True)
    seen = by_id(verdicts)
    assert all(seen[100 + k].removed is None and seen[100 + k].kept for k in range(30))
    left = by_id(line_quality.clean(many, verdicts))
    assert left[3].text == rows[3][1].split("\n", 1)[1] and len(left) == 70


def test_media(odd):
    found = by_id(media_fingerprint.media_columns(odd, keep_media=True, keep_codes=True))
    for i, text, *_ in ODD:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = found[i]
        assert media_fingerprint.from_wav(bytes(r.media)) == padded and r.n_bytes == len(raw) and r.payload_bytes == len(padded)
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-32:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    assert found[1].feature == found[8].feature and len(found[7].codes) > 100 and list(found[7].codes) == sorted(found[7].codes)


def test_peak_pairs_of_a_tone():
    tone = (128 + 100 * np.sin(np.arange(576 * 20) * 2 * np.pi * 36 / 576)).astype(np.uint8)
    t, bins = media_fingerprint.peaks(tone)
    assert (bins == 36).sum() > 3


def test_language(spark, odd, docs):
    found = by_id(language_id.classify(docs, language_id.learn(docs)))
    langs = dict(docs.select("doc_id", "lang").collect())
    held = [r for r in found.values() if r.held_out]
    assert {r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items()} == {True}
    assert sum(langs[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    few = by_id(language_id.classify(odd, language_id.learn(docs)))
    assert few[3].lang_pred == few[4].lang_pred == few[5].lang_pred == "und" and few[3].score == 0
    assert {r.lang_pred for r in language_id.classify(odd, {}).collect()} == {"und"}


def test_bpe_equals_library(odd, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    for rows in (odd, docs):
        found = by_id(bpe.tokenize(rows, bpe.vocabulary(), keep_ids=True, keep_text=True))
        for i, text in rows.select("doc_id", "text").collect():
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert list(found[i].ids) == ids and found[i].decoded == library.decode(ids, skip_special_tokens=False)
            assert found[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_cut_texts(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 500)
    coder = bpe.WordBpe(bpe.vocabulary())
    ids, shown = bpe.encode_batch(coder, [LONG[:20_000]])[0]
    monkeypatch.setattr(bpe, "PIECE", 1 << 20)
    assert ids.tolist() == bpe.encode_batch(coder, [LONG[:20_000]])[0][0].tolist() and " ".join(shown) == " ".join(map(str, ids))


def test_toxicity(spark, odd, docs):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    many = table(spark, "/root/testdata/sf0.01", "documents")
    chain = toxicity.learn(many, labels)
    found = by_id(toxicity.score(many, chain))
    truth = dict(labels.select("doc_id", "toxic").collect())
    held = [r for r in found.values() if r.held_out and truth.get(r.doc_id) is not None]
    hits = sum(r.predicted * truth[r.doc_id] for r in held)
    assert hits >= 0.7 * sum(truth[r.doc_id] for r in held) and hits >= 0.9 * sum(r.predicted for r in held)
    few = by_id(toxicity.score(odd, chain))
    assert few[3].score == few[4].score and few[3].predicted == 0
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    hot = spark.createDataFrame([(1, "You Idiot, a plain word", "", "", 1)], SCHEMA)
    text, r = "You Idiot, a plain word", toxicity.score(hot, chain).first()
    assert r.predicted == 1 and [text[s.start : s.end] for s in r.spans] == ["Idiot"]


def test_chain_against_enumeration():
    e, a = np.array([0.5, 3.0, 1.2, 0.1, 4.0]), np.array([[1.0, 0.3], [0.6, 2.0]])
    weight = np.zeros((2,) * 5)
    for y in np.ndindex(*weight.shape):
        path = (0, *y, 0)
        weight[y] = np.prod([a[i, j] for i, j in zip(path, path[1:], strict=False)]) * np.prod([e[k] for k in range(5) if y[k]])
    want = [weight.take(1, axis=k).sum() / weight.sum() for k in range(5)]
    lens = np.array([5, 5])
    p = toxicity.forward_backward(np.tile(e, 2), lens, a)[2]
    assert np.allclose(p, want * 2)


def test_packing(odd, docs):
    for rows in (odd, docs):
        found = packing.pack(rows, bpe.vocabulary(), keep_ids=True).collect()
        bins = {}
        for r in found:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= -(-sum(r.length for r in found) // 2048) + 2
        assert {r.doc_id for r in found} == {r.doc_id for r in rows.select("doc_id").collect()}


def test_plan_swaps_the_smallest_for_two():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0][0] == [6, 2, 2]


def test_urls(spark):
    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x", "http://example.org/fr", "x.com/fr/", None, "http://x.com/fr/1#t", "http://com/de/", "http://notcom/de/", "http://example.organic/es/", "a://b://c.org/d", "http://.org/", "http://org"]
    rows = spark.createDataFrame([(k % 11, u) for k, u in enumerate(urls * 3)], "page_id long, url string").repartition(4)
    rules = spark.createDataFrame([*url_rules.RULES], "host string, path string, verdict string")
    seen = url_rules.apply_rules(rows, rules).collect()
    assert len(seen) == 36
    for u in urls:
        rest = (u or "").lower().partition("://")[2]
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert [(r.rule, r.verdict) for r in seen if (r.host, r.path) == (host, path)][0] == best[1:]
    assert url_rules.apply_rules(rows.where("false"), rules).count() == 0
    assert {r.rule for r in url_rules.apply_rules(rows, rules.where("false")).collect()} == {None}


def test_nested_and_many_rules(spark, monkeypatch):
    """Ten thousand path rules of one host, nested ones, and ranges that begin inside intervals."""
    many = [("big.example", f"/{k}/", "block") for k in range(10_000)]
    deep = [("d.net", "/" + "a" * k, "allow" if k % 2 else "block") for k in range(40)] + [("net", "/aaa", "block"), ("net", "", "block"), ("", "/x", "block")]
    rules = spark.createDataFrame(many + deep + [("net", "", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = [f"s://w{k}.big.example/{k}/x" for k in range(0, 12_000, 40)] + ["s://d.net/" + "a" * k + "b" for k in range(50)] + ["s://e.d.net/aaaa"] * 300 + ["s:///xy", "s://net", "s://q.net", "s://q./x", None]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").repartition(5)
    given = {(h, p): v for h, p, v in many + deep}
    seen = {r.page_id: r for r in url_rules.apply_rules(rows, rules, "none").collect()}
    assert len(seen) == len(urls)
    for k, u in enumerate(urls):
        host, _, rest = (u or "").partition("://")[2].partition("/")
        path = "/" + rest if "/" in (u or "").partition("://")[2] else ""
        labels = host.split(".")
        fits = [(len(h) + len(p), len(h), h + p, given[h, p]) for h in (".".join(labels[j:]) for j in range(len(labels))) for n in range(len(path) + 1) if (p := path[:n], (h, p) in given)[1]]
        assert (seen[k].host, seen[k].path, seen[k].rule, seen[k].verdict) == (host, path, *max(fits, default=(0, 0, None, "none"))[2:])


def test_shards(odd, docs):
    found = kd_shards.kd_shards(docs).collect()
    total, size = sum(r["size"] for r in found), Counter()
    slots = {}
    for r in found:
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(size) == set(range(24)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(size.values()) <= total / 24 + 2 * max(r["size"] for r in found)
    few = by_id(kd_shards.kd_shards(odd))
    assert few[3]["size"] == 8 and few[3].text_crc32 == 0 and few[4]["size"] == 8 and len(few) == len(ODD)
    assert kd_shards.kd_shards(docs.where("false")).count() == 0


def slow_print(text):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = (text or "").encode().translate(low).split()
    s = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, docs):
    for rows in (odd, docs):
        text = dict(rows.select("doc_id", "text").collect())
        ids = sorted(text)
        fp = np.array([slow_print(text[i]) for i in ids], np.uint64)
        root = list(range(len(ids)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(len(ids)):
            for b in np.flatnonzero(np.bitwise_count(fp[a] ^ fp) <= 2):
                x, y = find(a), find(int(b))
                root[max(x, y)] = min(x, y)
        found = by_id(simhash.near_duplicates(rows))
        assert {i: found[i].fp & (1 << 64) - 1 for i in ids} == {i: int(x) for i, x in zip(ids, fp, strict=True)}
        assert {i: found[i].component_id for i in ids} == {i: ids[find(k)] for k, i in enumerate(ids)}
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("size", [7, 50, 100_000])
def test_gray_ranges_find_all_links(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "RANGE", size)
    monkeypatch.setattr(simhash, "LEAST", size)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) << np.uint64(1)
    far = [base ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 64, (6, 2))]
    dense = base[0] ^ rng.integers(0, 64, 40, dtype=np.uint64)  # one crowded node
    fps = np.unique(np.concatenate([base, dense, np.array([0, ~np.uint64(0)], np.uint64), *far]))
    pairs = [(k, j) for k in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[k] ^ fps[:k]) <= 2).tolist()]
    signed = [int(x) for x in fps.view(np.int64)]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    got = components.components(simhash.links(rows)).collect()
    want = components.components(spark.createDataFrame([(signed[a], signed[b]) for a, b in pairs], "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_gray_index_finds_all():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    index = simhash.GrayIndex(fps)
    pairs = {(int(fps[q]), int(fps[n])) for qs, ns in index.near(fps) for q, n in zip(qs, ns, strict=True)}
    assert pairs == {(int(a), int(b)) for a in fps for b in fps if bin(int(a ^ b)).count("1") <= 2}


def slow_repeats(text):
    seen, out = set(), {}
    for i in sorted(text):
        raw = (text[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats(spark, odd, docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "BLOCK", 1 << 12)
    rows = docs.select("doc_id", "text").where("doc_id < 120").union(odd.select(F.col("doc_id") + 1000, "text"))
    text = dict(rows.collect())
    if hot == 1:
        monkeypatch.setattr(repeats, "MANY", 1)
        monkeypatch.setattr(repeats, "SAMPLE", 4)
        monkeypatch.setattr(repeats, "OFTEN", 3)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(rows).collect()}
    assert found == slow_repeats(text)
    other = PASSAGE[::-1] * 2
    shared = spark.createDataFrame([(1, PASSAGE * 2), (1, other), (0, PASSAGE)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes - r.n_removed) for r in repeats.remove_repeats(shared).collect()) == [(0, len(PASSAGE)), (1, 0), (1, len(PASSAGE))]
    twice = spark.createDataFrame([(1, PASSAGE * 3), (1, PASSAGE * 3), (None, PASSAGE)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in repeats.remove_repeats(twice).collect()} == {(None, 0), (1, len(PASSAGE) * 3)}
    assert repeats.remove_repeats(rows.where("false")).count() == 0


def test_hot_group_keeps_first_runs(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(repeats, "CHUNK", 2000)
    raw = (PASSAGE + PASSAGE)[:140].encode()
    rows = pd.DataFrame([(7, d, 40, 40, 0, raw) for d in range(50)], columns=["gram", "d", "place", "lead", "tail", "raw"]).assign(t=0)
    out = pd.concat(repeats._by_gram(iter([rows.iloc[:20], rows.iloc[20:]])))
    assert set(out.d) == set(range(1, 50)) and set(zip(out.a, out.z, strict=True)) == {(0, 140)}


def test_components_of_a_chain(spark):
    rows = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 100)], "u long, v long")
    found = dict(components.components(rows).collect())
    assert found == {k: 0 for k in range(41)} | {90: 90, 100: 90}
