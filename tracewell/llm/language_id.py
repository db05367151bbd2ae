"""Operator 3: language identification by compression.

Each language gets a zstandard raw-content dictionary from a bounded sample of
its labelled texts. Texts are lower-cased and everything in ASCII that is no
letter becomes white space. A text is cut into CHUNK-byte pieces; every piece is
compressed with every dictionary and the language with the smallest total wins.
A winner whose margin over the second is under MARGIN is marked rejected.

The sample (the only bound): SAMPLE_DOCS documents of a language with the least
hash, SAMPLE_CHARS characters in a row of each (of shorter texts all); the
dictionary has DICT_BYTES bytes, shared evenly by these parts. Rows with
crc32(doc_id as text) mod 4 = 2 are never learned from.

Defined cases: null text or text without a letter gives und, score 0; with
nothing to learn from (an empty table too), every row is und; repeated rows and
equal texts get equal answers; a null doc_id stays null and is not learned from,
and rows that share one are judged each by its own text; ties go to the first
language by name; very long texts are compressed whole; other columns of docs
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import crc_mod, hash_sample, map_texts, table

SAMPLE_DOCS = 64
SAMPLE_CHARS = 1024
DICT_BYTES = 1 << 16
CHUNK = 4096
#: zstandard's parameters: short matches count, small tables keep a piece cheap.
PACKING = {"window_log": 17, "chain_log": 15, "hash_log": 15, "search_log": 2, "min_match": 4, "target_length": 0, "strategy": 3}
NO_LETTERS = {i: " " for i in range(128) if not chr(i).isalpha()}
MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")


def folded(text: str) -> str:
    return " ".join(text.lower().translate(NO_LETTERS).split())


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content by language, from a bounded sample."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2))
    chosen = hash_sample(rows.select("doc_id", "lang"), "lang", SAMPLE_DOCS).select("doc_id").distinct()  # SAMPLE_DOCS a language
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # of rows that share an id one
    # a part from the middle of the text, at a place that depends on the text alone
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    rows = rows.select("lang", "doc_id", F.substring("text", F.pmod(F.hash("text"), room + 1) + 1, F.lit(SAMPLE_CHARS)).alias("part"))
    found: dict[str, list] = {}
    for r in sorted(rows.collect()):
        part = folded(r.part).encode("utf-8", "replace")
        if part not in found.setdefault(r.lang, []):
            found[r.lang].append(part)
    # every part gets an equal share of the dictionary; zstandard needs 8 bytes at least
    return {k: b"\n".join(x[: DICT_BYTES // len(v)] for x in v).rjust(8) for k, v in sorted(found.items())}


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    names = list(dictionaries)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def prepare() -> Callable:
        import zstandard

        packers = []
        for raw in shared.value.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**PACKING)
            d.precompute_compress(compression_params=how)
            packers.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))

        def judge(text: str | None) -> tuple[str, float, bool]:
            if not names or not text or not LETTER.search(text):
                return "und", 0.0, True
            raw = folded(text).encode("utf-8", "surrogatepass") or b" "
            parts = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
            size = np.array([sum(len(p.compress(x)) for x in parts) for p in packers], float)
            best = int(size.argmin())
            rest = np.delete(size, best)
            margin = float((rest.min() - size[best]) / rest.min()) if len(rest) else 1.0
            return names[best], float(1 / (1 + np.exp(-40 * margin))), margin < MARGIN

        def work(texts: list[str | None]) -> tuple[None, list]:
            rows = [judge(t) for t in texts]
            return None, [[r[k] for r in rows] for k in range(3)]

        return work

    rows = docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return map_texts(rows, ["doc_id", "held_out"], prepare, "lang_pred string, score double, rejected boolean")


def op3_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs))
