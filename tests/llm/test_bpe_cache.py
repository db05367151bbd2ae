"""The encoder's cache: what it keeps, and that it changes no id."""

import random

from tokenizers import Tokenizer

from tracewell.llm import bpe

ODD = ["the <|ENDOFTEXT|> end", "<|endoftext|>tail", "a\x1cb \x1f\x1d c", "it's don'T,x", "́ á   b", "x" * 5000 + " " + "é!" * 900, "ΑΣ ς 12½", "aaaa aaa"]


def ids(coder, texts):
    return [x.tolist() for x, _ in bpe.encode_batch(coder, texts)]


def test_words_met_again_are_merged_once(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 60)
    coder, merged = bpe.WordBpe(bpe.vocabulary()), []
    merge = coder.merge
    monkeypatch.setattr(coder, "merge", lambda words: merged.extend(words) or merge(words))
    for k in range(20):
        bpe.encode_batch(coder, [f"common words here. {' '.join(f'once{chr(97 + k)}{chr(97 + j)}' for j in range(20))}"])
    assert [merged.count(w) for w in ("common", "words", "here")] == [1, 1, 1]
    assert len(coder.known) <= 60 + 30


def test_small_caches_change_no_id(monkeypatch):
    library, r = Tokenizer.from_file(bpe.vocabulary()), random.Random(1)
    texts = ODD + [" ".join(r.choice(ODD)[: r.randrange(40)] for _ in range(9)) for _ in range(60)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for words, chars in ((400_000, 8_000_000), (20, 8_000_000), (400_000, 100)):
        monkeypatch.setattr(bpe, "CACHE_WORDS", words)
        monkeypatch.setattr(bpe, "CACHE_CHARS", chars)
        coder = bpe.WordBpe(bpe.vocabulary())
        assert [ids(coder, [t])[0] for t in texts] == want
        index = coder.index(texts)
        assert [" ".join(coder.decimal(i)) for i in index] == [" ".join(map(str, w)) for w in want]


def test_a_worker_keeps_its_coder():
    assert bpe.coder(bpe.vocabulary(), False) is bpe.coder(bpe.vocabulary(), False)
