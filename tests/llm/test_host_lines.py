"""Boilerplate of a few percent of a host's documents is removed."""

from tracewell.llm import line_quality


def test_line_of_five_percent(spark):
    own = lambda k: " ".join("".join(chr(97 + int(c)) for c in str(k * 61 + j)) for j in range(60))
    rows = [(k, ("A line of many documents\n" if k % 20 == 0 else "Rare\n" if k % 40 == 1 else "") + own(k), "h") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in line_quality.line_quality(docs).collect()}
    assert {k for k, r in found.items() if r.removed} == set(range(0, 600, 20))  # 30 documents; the 15 of the other line are under the floor
    assert all(r.kept for r in found.values())
