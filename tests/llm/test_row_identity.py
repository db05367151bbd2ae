"""Every operator keeps its rows apart: null, large and shared ids, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from tracewell.llm import bpe, kd_shards, language_id, line_quality, media_fingerprint, packing, repeats, simhash, toxicity

BIG = (1 << 53) + 1
ROWS = [(None, "one text"), (BIG, "one text"), (BIG, "another text, longer"), (BIG, "another text, longer"), (BIG + 1, None), (-3, ""), (None, None)]
CHAIN = toxicity.Chain({"text": 2.0}, -4.0, toxicity.np.zeros((2, 2)), toxicity.np.array([1.0, 1.0, 0.0]))
OPERATORS = {
    "op1": line_quality.line_quality,
    "op2": media_fingerprint.media_columns,
    "op3": lambda docs: language_id.classify(docs, {"en": b"some english text", "de": b"ein deutscher text"}),
    "op4": lambda docs: bpe.tokenize(docs, bpe.vocabulary()),
    "op5": lambda docs: toxicity.score(docs, CHAIN),
    "op6": lambda docs: packing.pack(docs, bpe.vocabulary()),
    "op8": kd_shards.kd_shards,
    "op9": simhash.near_duplicates,
    "op10": repeats.remove_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_apart(spark, name):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("source", F.lit("h"))
    for c in ("size", "gram", "fp", "score", "_id", "_d", "k0", "t", "row", "spans", "length"):
        docs = docs.withColumn(c, F.lit("x"))
    got = OPERATORS[name](docs.repartition(2)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
    sizes = {"op1": "n_words", "op2": "n_bytes", "op4": "n_tokens", "op8": "size", "op10": "n_bytes"}
    if name in sizes:
        want = {"op1": lambda t: len(t.split()), "op4": lambda t: len(t.replace(",", " ,").split()), "op8": lambda t: len(t) + 8}.get(name, len)
        assert sorted((str(r.doc_id), r[sizes[name]]) for r in got) == sorted((str(i), want(t or "")) for i, t in ROWS)
    empty = OPERATORS[name](docs.where("false"))
    assert empty.count() == 0 and "doc_id" in empty.columns
