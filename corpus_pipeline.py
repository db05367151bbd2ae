"""A corpus from documents to packed sequences: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of
docs in all but the last. Labels are read from sf_dir, never passed along.

Defined cases, in every stage: rows with a null doc_id and rows that share one
are rows of their own; columns beside doc_id, text, source and n_chars may have
any name and value and come through unchanged, nulls and large integers
included; texts are read whole; an empty table gives an empty result. Null texts
have no words and go in the first stage; handed to a later one they stay null
(they are one another's copies in the third, and the end id alone in the last).
Of repeated rows the third stage keeps one. Ties are settled as the operators
say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import line_quality, near_copies, packing, repeats, toxicity
from tracewell.llm.bpe import vocabulary
from tracewell.llm.common import remove, restored, scratch, scratch_path, shielded, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines of their host leave the others."""
    return line_quality.clean_rows(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    safe = shielded(docs)
    scored = toxicity.score(safe, toxicity.learn(docs, table(spark, sf_dir, "labels")), list(safe.columns))
    return restored(scored.where("predicted = 0"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays."""
    return near_copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes inside repeated windows leave the texts."""
    safe = shielded(docs)
    kept = restored(repeats.remove_repeats(safe, keep=list(safe.columns)), docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of every piece in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality rules", quality), ("toxicity", toxic), ("simhash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages), ("best-two-fit packing", packed)]

#: Trained models, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has read or written on the way goes when its result is stored."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
