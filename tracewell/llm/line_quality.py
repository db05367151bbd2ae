"""Operator 1: quality rules by cross-document line frequency.

Lines are normalised (ASCII lower case, digits to 0, white space folded) and
hashed. For each host (the column source) the documents (rows) that hold a line
are counted. A line found in more than max(min_docs, share * documents of the
host) documents is removed. A document that loses lines is depleted and
rejected if more than max_loss of its words go or fewer than MIN_WORDS are left. With once_per_text equal texts of one host count
as one document, so that a page copied word for word is no boilerplate.

Defined cases: null text has no word, fails the base rules and is rejected; an
empty line or a line without a word is never counted or removed; a null host is
a host of its own; repeated rows are documents each and get equal verdicts; rows
that share a doc_id but not a text are judged each by its own text; a null
doc_id stays null; a count equal to a limit removes nothing (ties stay); very
long texts are read whole; an empty table gives an empty result; other columns
of docs are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import SPACES, map_texts, materialize, partitions, restored, shielded, table

MIN_WORDS = 50
MIN_DOCS = 20
SHARE = 0.01
MAX_LOSS = 0.7


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    pair = w[:-1] * len(ids) + w[1:]
    pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words)


def _measure() -> Callable:
    return lambda texts: (None, list(np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5).T))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, source, and what tells rows apart: _none, _id, _hash (equal for repeated rows alone)."""
    source = F.coalesce("source", F.lit(""))
    return docs.select("doc_id", "text", source.alias("source"), F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64("text", source).alias("_hash"))


KEY = ["_none", "_id", "_hash"]


def base_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the key of the row, the base counts and base_failed."""
    counts = map_texts(keyed(docs), ["doc_id", *KEY], _measure, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def line_key(line: Column) -> Column:
    """Hash of the normalised line; 0 words give null."""
    folded = F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"), "[ \\t\\x0B\\f\\r]+", " "))
    return F.when(folded != "", F.xxhash64(folded))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, once_per_text: bool = False) -> DataFrame:
    """(source, line): lines above the limit of their host."""
    rows = keyed(docs).where("text is not null")
    lines = F.filter(F.array_distinct(F.transform(F.split("text", "\n"), line_key)), lambda x: x.isNotNull())
    sizes, seen = rows.select("source", "_hash"), rows.select("source", "_hash", F.explode(lines).alias("line"))
    if once_per_text:
        sizes, seen = sizes.distinct(), seen.distinct()
    size = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > min_docs)
    return seen.join(size, "source").where(F.col("docs") > share * F.col("n")).select("source", "line")


def line_hits(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(key of the row, removed array<int>, lost_words): positions of the lines to remove."""
    words = lambda x: F.size(F.filter(F.split(x, "[ \\t\\x0B\\f\\r]+"), lambda w: w != ""))
    each = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("line"), words(x).alias("words")))
    each = F.filter(each, lambda x: x["line"].isNotNull())
    # A line of a large host may be in a third of all documents: its rows are dealt over salts, more of them on a larger cluster.
    salts = max(32, partitions(docs.sparkSession) // 8)
    salt = F.pmod(F.xxhash64("_id", "_hash"), F.lit(salts)).cast("int")
    rows = keyed(docs).where("text is not null").select(*KEY, "source", salt.alias("salt"), F.explode(each).alias("e"))
    rows = rows.select(*KEY, "source", "salt", "e.*")
    spread = lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hit = rows.join(spread, ["source", "line", "salt"]).groupBy(*KEY).agg(F.collect_set(F.struct("pos", "words")).alias("hits"))  # repeated rows hit alike
    lost = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return hit.select(*KEY, F.col("hits.pos").alias("removed"), lost.alias("lost_words"))


def line_quality(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, max_loss: float = MAX_LOSS, once_per_text: bool = False) -> DataFrame:
    """Verdict per document: base counts, removed line positions, lost words, kept."""
    hits = line_hits(docs, frequent_lines(docs, min_docs, share, once_per_text))
    out = base_rules(docs).join(hits, KEY, "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("lost_words")
    depleted = (F.col("lost_words") > 0) & ((F.col("lost_words") > max_loss * F.col("n_words")) | (left < MIN_WORDS))
    kept = ~F.col("base_failed") & ~depleted
    return out.withColumn("kept", kept).drop(*KEY)


def clean(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Kept documents, their frequent lines taken out; the columns of docs. doc_id must tell rows apart."""
    kept = verdicts.where("kept").select("doc_id", F.col("removed").alias("_lines"))
    joined = shielded(docs).join(kept, "doc_id")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_lines", i))
    text = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return restored(joined.withColumn("text", text), docs)


def clean_rows(docs: DataFrame) -> DataFrame:
    """Kept rows of docs, cleaned; told apart by an id written once, whatever their doc_id."""
    given = F.struct(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns)])
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", "source", given.dropFields(f"_c{docs.columns.index('text')}").alias("_given")), "rows")
    out = clean(rows, line_quality(rows))
    fresh = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[fresh.get(c, F.col("_given")[f"_c{k}"]).alias(c) for k, c in enumerate(docs.columns)])


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed_lines"))
