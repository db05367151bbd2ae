"""Operator 11: document fingerprints of closed syncmers. DataFrame functions only.

A k-mer is K words in a row, its inner substrings are the K - S + 1 runs of S words in
it. A k-mer is an anchor if the least inner substring, by hash, is its first or its
last one. That depends on the k-mer alone: equal stretches have equal anchors wherever
they stand, and of any K - S + 1 k-mers in a row one at least is an anchor (the one
that begins or ends with the stretch's least inner substring).

A fingerprint is the sequence of a text's anchors, 32 bits each, written as 8
hexadecimal digits. Two fingerprints are matched by position: of the anchors they
share, in the order in which each text has them first, the pairs of neighbours found
in both are counted. Their number and one, as a share of all anchors of either text,
is the likeness: 1 for equal fingerprints, 0 without a shared anchor; a stretch put
elsewhere costs only its ends.

The next document's beginning and anchors move to the document, keyed by place in the
order of doc_id: the order is cut into ranges, and one row a range carries the order
from a range to the next. Texts are shuffled once.

Defined cases: null texts are empty; a text without a word has an empty fingerprint,
and two of those have likeness 1; a text in which no k-mer is an anchor (one of few words)
has one anchor, the whole sequence; null doc_ids come last in the order, rows that share a doc_id are
ordered by a hash of the text, and repeated rows follow one another; a single document
is its own next one; very long texts are read whole; an empty table gives an empty
result; other columns of docs are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import materialize, partitions, table

#: Words of a k-mer and of an inner substring.
K, S = 5, 2
KEY = ["none", "id", "h"]
#: Copies of a row written by one task at a time.
BLOCK = 1000


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df and out: the anchors of the text as an array of ints, in order."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size("_h")
    inner = F.zip_with(F.slice("_h", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("_h", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    at = lambda i, d: F.get("_s", i + d)
    closed = lambda i: F.least(at(i, 0), at(i, K - S)) <= F.least(*[at(i, d) for d in range(1, K - S)])
    narrow = lambda h: F.shiftright(h, 32).cast("int")
    chosen = F.transform(F.filter(F.sequence(F.lit(0), n - K), closed), lambda i: narrow(F.xxhash64(at(i, 0), at(i, 2), at(i, K - S))))
    short = F.when(n > 0, F.array(narrow(F.xxhash64("_h")))).otherwise(F.array().cast("array<int>"))
    hashed = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w))).withColumn("_s", inner)
    hashed = hashed.withColumn("_c", F.when(n >= K, chosen))
    return hashed.withColumn(out, F.when(F.size(F.coalesce("_c", F.array().cast("array<int>"))) == 0, short).otherwise(F.col("_c"))).drop("_h", "_s", "_c")


def written(anchors: str) -> Column:
    """The fingerprint as text."""
    digits = F.transform(anchors, lambda a: F.lower(F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    return F.array_join(digits, "")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df and out: likeness of the anchors a and b, from 0 to 1."""
    df = df.withColumn("_a", F.array_intersect(a, b)).withColumn("_b", F.array_intersect(b, a)).withColumn("_n", F.size(F.array_union(a, b)))
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(2), F.size(c)), lambda x, y: x.cast("long") * (1 << 32) + y)
    kept = F.size(F.array_intersect(pairs("_a"), pairs("_b"))) + 1
    like = F.when(F.col("_n") == 0, 1.0).when(F.size("_a") == 0, 0.0).otherwise(kept / F.col("_n"))
    return df.withColumn(out, like).drop("_a", "_b", "_n")


def rows_of(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def neighbours(rows: DataFrame) -> DataFrame:
    """KEY, n_next: (key) of the document after each and n_prev: (key, n) of the one before; equal rows count once."""
    spark = rows.sparkSession
    keys = rows.groupBy(*KEY).agg(F.max(F.length("text")).alias("n"))
    dealt = materialize(keys.repartitionByRange(partitions(spark), *KEY).withColumn("part", F.spark_partition_id()), "ordered-keys")
    this = F.struct(*KEY, "n")
    ends = dealt.groupBy("part").agg(F.min(this).alias("first"), F.max(this).alias("last"))  # one row a range
    by_part = Window.orderBy("part")
    whole = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(by_part), F.first("first").over(whole)).alias("ahead"), F.coalesce(F.lag("last").over(by_part), F.last("last").over(whole)).alias("behind"))
    inside = Window.partitionBy("part").orderBy(*KEY)
    near = dealt.select("part", *KEY, F.lead(this).over(inside).alias("lead"), F.lag(this).over(inside).alias("lag"))
    return near.join(F.broadcast(ends), "part").select(*KEY, F.coalesce("lead", "ahead").alias("n_next"), F.coalesce("lag", "behind").alias("n_prev"))


def edited(text: Column, begin: Column) -> Column:
    """The text with its last quarter replaced by begin, which holds as many characters at most."""
    n = F.length(text)
    return F.concat(F.substring(text, F.lit(1), n - F.floor(n / 4).cast("int")), begin)


def quarter(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), F.floor(n / 4).cast("int"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    rows = rows_of(docs)
    order = materialize(neighbours(rows), "neighbours")
    # copies of a row are one from here on: combined before the shuffle, however many they are
    texts = rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = texts.where("copies > 0")  # all three uses below so need the same columns and share one shuffle
    placed = texts.join(order, KEY)
    sent = with_anchors(placed, "text", "next_anchors").select(*[F.col(f"n_prev.{k}").alias(k) for k in KEY], quarter(F.col("text"), F.col("n_prev.n")).alias("begin"), "next_anchors")
    last = with_anchors(texts, "text", "anchors").join(sent, KEY)
    # of equal rows each but the last has another of them behind it
    again = with_anchors(texts.where("copies > 1"), "text", "anchors").withColumn("begin", quarter(F.col("text"), F.length("text"))).withColumn("next_anchors", F.col("anchors"))
    again = described(again, "copies - 1 as copies")
    again = again.withColumn("block", F.explode(F.expr(f"sequence(0, (copies - 1) div {BLOCK})"))).repartition(partitions(docs.sparkSession))
    again = again.withColumn("block", F.explode(F.expr(f"sequence(1, least({BLOCK}, copies - block * {BLOCK}))"))).drop("block", "copies")
    return described(last).unionByName(again)


def described(rows: DataFrame, *more: str) -> DataFrame:
    made = rows.withColumn("edited", edited(F.col("text"), F.col("begin")))
    made = with_likeness(with_anchors(made, "edited", "edited_anchors"), "anchors", "edited_anchors", "near_edited")
    made = with_likeness(made, "anchors", "next_anchors", "near_next")
    return made.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("anchors").alias("fingerprint"),
        written("edited_anchors").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        *[F.expr(m) for m in more],
    )


def op11_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
