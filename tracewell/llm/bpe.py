"""Operator 4: BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks every
neighbouring pair up (by table, or by binary search over the sorted pair keys if
a merge has made it), takes the
lowest rank of each word and merges all its occurrences, left to right; words
without a known pair leave the array. No word spans white space: stretches without
it are remembered with their ids in a bounded cache, so a batch only splits and merges those it
has not met.

The vocabulary file is a tokenizers JSON file (path is a parameter): NFC, lower
case, a split pattern, bytes shown as characters and a word-end suffix.

Defined cases: null and empty texts give no ids and an empty decoded text;
repeated rows give equal rows; a null doc_id stays null, and rows that share one
are encoded each by its own text; very long texts are cut at ASCII white space,
where no token can span, and are encoded whole; of equal ranks the leftmost pair
merges first; an empty table gives an empty result; other columns of docs are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import compress, islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.common import map_texts, table

NONE = np.iinfo(np.int32).max
#: Above so many stretches or characters a coder forgets those not met again.
CACHE_WORDS, CACHE_CHARS = 400_000, 8_000_000
#: Characters encoded at once, at least; a text is cut after as many.
PIECE = 1 << 22


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as it is, the rest from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """shown: also remember each word's ids in decimal."""

    def __init__(self, path: str, shown: bool = True):
        self.shown = shown
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.n = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.n
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        chars = byte_characters()
        self.base = np.array([vocab[c] for c in chars] + [vocab[c + end] for c in chars], np.int64)  # bytes, then bytes at a word's end
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.append(order, NONE).astype(np.int32), made[order]
        self.pairs = self._pair(np.repeat(self.base, 512), np.tile(self.base, 512))
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.none = np.zeros(0, np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__  # the next number for an unknown word
        self.flat, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.digits: list[str] = []
        self.chars, self.again = 0, np.zeros(0, bool)
        # no other key holds a space
        self._store([self.known[" " + t] for t in self.special], np.array([*self.special.values()], np.int32), np.ones(len(self.special), np.int64))

    def _forget_unused(self) -> None:
        """Keep what was met again in a later batch, if that is less than half of what may be known."""
        keep = self.again
        keep[: len(self.special)] = True
        words, index = list(compress(self.known, keep.tolist())), np.flatnonzero(keep)
        flat, lens = self.ids(index), self.lens[index]
        self.forget()
        if 2 * len(words) <= CACHE_WORDS and 2 * sum(map(len, words)) <= CACHE_CHARS:
            self.chars = sum(map(len, words))
            self._store([self.known[w] for w in words], flat, lens)

    def _store(self, index: list[int] | np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        """The ids of known words, by their numbers."""
        more = np.zeros(len(self.known) - len(self.lens), np.int64)
        self.starts, self.lens = np.append(self.starts, more), np.append(self.lens, more)
        self.again = np.append(self.again, more > 0)
        self.starts[index], self.lens[index] = len(self.flat) + np.cumsum(lens) - lens, lens
        self.flat = np.append(self.flat, flat.astype(np.int32))
        if self.shown:
            self.digits += [""] * len(more)
            shown, at = list(map(str, flat.tolist())), np.cumsum(lens).tolist()
            for k, start, end in zip(index, [0, *at], at, strict=False):
                self.digits[k] = " ".join(shown[start:end])

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs among the keys; that of no key is behind the last."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys)).astype(np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each.

        Pairs of bytes are looked up in a table, later only those that a merge has made.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        code = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        code[np.cumsum(size) - 1] += 256
        sym = self.base[code]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        none = len(self.keys)
        at = np.append(np.where(word[:-1] == word[1:], self.pairs[code[:-1] * 512 + code[1:]], none), none).astype(np.int32)
        done_word, done_sym = [word[:0]], [sym[:0]]
        while len(sym):
            rank = self.ranks[at]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            lowest = np.repeat(best, length)
            over = lowest == NONE
            done_word.append(word[over])
            done_sym.append(sym[over])
            hit = np.flatnonzero((rank == lowest) & ~over)
            # of a run of touching pairs (as in aaa) every other one merges
            run = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1)) if len(hit) else hit
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 1
            hit = hit[~odd]
            sym[hit] = self.made[at[hit]]
            keep = ~over
            keep[hit + 1] = False
            moved = np.cumsum(keep)[hit] - 1
            sym, word, at = sym[keep], word[keep], at[keep]
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            inside = changed[changed + 1 < len(sym)]
            inside = inside[word[inside] == word[inside + 1]]
            at[changed] = none
            at[inside] = self._pair(sym[inside], sym[inside + 1])
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def words(self, text: str) -> list[str]:
        """Stretches without white space, in which all words lie; special tokens behind a space."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(" " + part)
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()  # each character alone: no final sigma
                # str.split also takes these four, which are no white space to the pattern
                out += filter(None, self.space.split(part)) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()
        return out

    def index(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Cache positions of the stretches of each text; the words of unknown ones are merged first."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget_unused()
        old, get = len(self.known), self.known.__getitem__
        out = [np.fromiter(map(get, t), np.int64, len(t)) for t in map(self.words, texts)]
        met = np.concatenate([self.none, *out])
        self.again[met[met < old]] = True
        new = list(islice(self.known, old, None))
        if new:
            self._learn(new, old)
        return out

    def _learn(self, new: list[str], old: int) -> None:
        """The ids of stretches, numbered from old on, are those of their words."""
        several = [k for k, s in enumerate(new) if not (s.isascii() and s.isalpha())]
        sizes, inner = [], []
        for k in several:
            found = self.pattern.findall(new[k])
            sizes.append(len(found))
            if len(found) != 1:
                inner += map(self.known.__getitem__, found)
        words = list(islice(self.known, old, None))
        self.chars += sum(map(len, words))
        several, sizes = np.array(several, np.int64), np.array(sizes, np.int64)
        several, sizes = several[sizes != 1], sizes[sizes != 1]
        single = np.delete(np.arange(len(words)), several)
        self._store(old + single, *self.merge([words[k] for k in single.tolist()]))
        inner = np.array(inner, np.int64)
        self.again[inner[inner < old]] = True
        upto, ends = np.append(0, np.cumsum(self.lens[inner])), np.cumsum(sizes)
        self._store(old + several, self.ids(inner), upto[ends] - upto[ends - sizes])

    def ids(self, index: np.ndarray) -> np.ndarray:
        lens = self.lens[index]
        n = int(lens.sum())
        return self.flat[np.repeat(self.starts[index] - np.cumsum(lens) + lens, lens) + np.arange(n)]

    def decimal(self, index: np.ndarray) -> list[str]:
        return list(map(self.digits.__getitem__, index.tolist())) if self.shown else []

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def coder(path: str, shown: bool) -> WordBpe:
    """The coder of a Python worker, whose later tasks find it with the words it knows."""
    return WordBpe(path, shown)


def pieces(text: str) -> Iterator[str]:
    """A long text, cut before ASCII white space."""
    at = 0
    while len(text) - at > PIECE:
        cut = next((m.start() for m in re.compile(r"[ \t-\r]").finditer(text, at + PIECE)), len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of about PIECE characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def encode_batch(bpe: WordBpe, texts: list[str | None]) -> list[tuple[np.ndarray, list[str]]]:
    """For each text its ids and their decimal forms by word."""
    out = []
    for t in texts:
        if t and len(t) > PIECE:
            ids, shown = [], []
            for p in pieces(t):
                (index,) = bpe.index([p])
                ids.append(bpe.ids(index))
                shown += bpe.decimal(index)
            out.append((np.concatenate(ids), shown))
        else:
            out.append(t or "")
    short = [k for k, t in enumerate(out) if isinstance(t, str)]
    for k, index in zip(short, bpe.index(out[k] for k in short), strict=True):
        out[k] = (bpe.ids(index), bpe.decimal(index))
    return out


def tokenize(docs: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Digests of the ids and of the text decoded from them; keep_* adds these themselves."""
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def prepare() -> Callable:
        bpe = coder(path, True)

        def work(texts: list[str | None]) -> tuple[None, list]:
            rows = []
            for start, end in groups(texts):
                for ids, shown in encode_batch(bpe, texts[start:end]):
                    text = bpe.decode(ids)
                    row = (len(ids), hashlib.sha256(" ".join(shown).encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                    rows.append(row + (ids,) * keep_ids + (text,) * keep_text)
            return None, [[r[k] for r in rows] for k in range(3 + keep_ids + keep_text)]

        return work

    return map_texts(docs, ["doc_id"], prepare, made)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), vocabulary())
