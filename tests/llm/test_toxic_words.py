"""Words of a few toxic documents are tied to toxicity too."""

from tracewell.llm import toxicity


def test_rare_toxic_word(spark):
    plain = lambda k: " ".join(f"word{(k * 7 + j) % 90}" for j in range(30))
    rows = [(k, plain(k), 0) for k in range(1000)]
    rows += [(1000 + k, f"{plain(k)} {'seltenwort' if k % 32 == 0 else 'common'} {plain(k + 1)}", 1) for k in range(1000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    chain = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    text = plain(3) + " seltenwort"
    one = toxicity.score(spark.createDataFrame([(1, text), (2, plain(3))], "doc_id long, text string"), chain)
    found = {r.doc_id: r for r in one.collect()}
    assert found[1].predicted == 1 and [text[s.start : s.end] for s in found[1].spans] == ["seltenwort"]
    assert found[2].predicted == 0
