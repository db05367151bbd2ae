"""Operator 7: URL filters by a sort-merge range join. DataFrame functions only.

A rule (host, path) becomes one interval of canonical keys: the labels of the
host, reversed, then its path; the interval holds every key that goes on from
there. A URL has one key for its host and one for each domain the host lies in,
each with the URL's path: it fits a rule if one of its keys lies in the rule's
interval. Intervals of prefixes nest or are apart.

Interval starts, ends and URL keys are sorted together and swept. The running
number of open intervals is the depth of the stack; the interval on top of it at
a URL key is the last start that opened at that depth. So the stack is kept by
two windows, a row a rule, and no row carries a list of rules. The longest of the
tops of a URL's keys wins.

The sweep runs in ranges of the sorted keys. A key that many URLs share is split
by row, and the depth and the open starts at the beginning of a range come from
the ranges before it: one row a range, and one per range and depth.

Defined cases: a null url or one without :// has an empty host and path; no
fitting rule gives a null rule and the default verdict; of equally long rules
the one with the longer host wins, of rules with equal host and path the one
whose verdict comes last by name (block over allow); rules with a null host or
path fit nothing; repeated rows and rows that share a page_id are rows each, a
null page_id stays null; very long urls are keys whole; an empty table gives an
empty result; other columns of pages are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import materialize, partitions, table

#: Fixed rules of the query: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Neither ? nor # is in a host or path: one ends the labels of a key, the other its host.
LABEL, HOST = "?", "#"


def split_url(pages: DataFrame) -> DataFrame:
    pattern = "^[\\s\\S]*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract("url", pattern, k), F.lit(""))
    return pages.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def key(labels: Column, path: Column) -> Column:
    """www.example.org, /a -> org?example?www#/a, as bytes."""
    return F.concat(F.array_join(labels, LABEL), F.lit(HOST), path).cast("binary")


def intervals(rules: DataFrame) -> DataFrame:
    """A start (step 1) and an end (step -1) of every rule."""
    given = rules.where("host is not null and path is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    given = given.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    at = key(reversed_labels(F.col("host")), F.col("path"))
    length = F.length("host") + F.length("path")
    rule = F.struct(length.alias("length"), F.length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict")
    starts = given.select(at.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), rule.alias("rule"))
    # no text goes on with byte 255, so an end comes behind all that its interval holds
    ends = given.select(F.concat(at, F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.lit(None).cast(starts.schema["rule"].dataType).alias("rule"))
    return starts.unionByName(ends)


def url_keys(urls: DataFrame) -> DataFrame:
    """One row for the host of a URL and for each domain it lies in."""
    labels = urls.select("row", "path", reversed_labels(F.col("host")).alias("labels"))
    each = labels.select("row", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"))
    return each.select(key(F.slice("labels", F.lit(1), F.col("n")), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "row")


def sweep(events: DataFrame) -> DataFrame:
    """(row, rule): for every URL key the innermost rule that is open there."""
    spark = events.sparkSession
    dealt = events.repartitionByRange(partitions(spark), "key", "kind", F.xxhash64("row")).withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "url-ranges")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    moves = dealt.groupBy("range").agg(F.sum("step").alias("step"))  # one row a range
    entry = moves.select("range", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("entry"))
    inside = Window.partitionBy("range").orderBy("key", "kind", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = dealt.withColumn("depth", F.sum("step").over(inside)).join(F.broadcast(entry), "range")
    steps = steps.withColumn("depth", F.col("depth") + F.col("entry"))
    steps = materialize(steps.where("kind < 2").select("range", "depth", "key", "kind", "row", "rule"), "url-depths")

    # the last start of each depth in each range, carried to the ranges behind it
    last = steps.where("kind = 0").groupBy("depth", "range").agg(F.max_by("rule", "key").alias("rule"))
    asked = steps.where("kind = 1 and depth > 0").select("depth", "range").distinct()
    upto = Window.partitionBy("depth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.join(last, ["depth", "range"], "full_outer").withColumn("carried", F.last("rule", ignorenulls=True).over(upto)).drop("rule")

    at_depth = Window.partitionBy("range", "depth").orderBy("key", "kind", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = steps.where("depth > 0").withColumn("top", F.last("rule", ignorenulls=True).over(at_depth)).where("kind = 1")
    return tops.join(carried, ["depth", "range"], "left").select("row", F.coalesce("top", "carried").alias("rule"))


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url)."""
    urls = split_url(pages.select("page_id", "url")).select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path")
    urls = materialize(urls, "urls")
    events = url_keys(urls).unionByName(intervals(rules), allowMissingColumns=True)
    best = sweep(events).groupBy("row").agg(F.max("rule").alias("best"))
    out = urls.join(best, "row", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"select * from values {rows} as t(host, path, verdict)")
    return apply_rules(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = """
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '^(?:.|\\n)*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^(?:.|\\n)*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(rhost, rpath, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (
  select p.*, r.*, row_number() over (partition by page_id order by length(rhost) + length(rpath) desc nulls last, length(rhost) desc) as k
  from p left join r on (host = rhost or suffix(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rhost || rpath as rule, coalesce(verdict, 'allow') as verdict from m where k = 1
"""
