"""Fixed-width first-break files: records of `fb` lines, ten 5-character values each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the format.
NONE, PER_LINE, RECORD = -9999, 10, "* rec.no.="


def milliseconds(pick: Column, dt: float) -> Column:
    """Time of a pick; NONE for no pick and times that round to 0 or less."""
    t = F.rint(pick * dt).cast("long")
    return F.when(pick.isNull() | (pick == 0) | (t <= 0), F.lit(NONE)).otherwise(t).cast("long")


def lines(picks: DataFrame, keys: list[str], dt: float, channels: int) -> DataFrame:
    """Lines of keys, rec, channel (from 1), pick: one row per line, in order of rec and line.

    Channels without a row have no pick; of several rows of a channel the
    latest pick counts. A record is one row of `channels` values at most.
    """
    cell = picks.groupBy(*keys, "rec", "channel").agg(F.max("pick").alias("pick"))
    row = cell.groupBy(*keys, "rec").agg(F.map_from_entries(F.collect_list(F.struct("channel", "pick"))).alias("m"))
    values = F.transform(F.sequence(F.lit(1), F.lit(channels)), lambda c: milliseconds(F.element_at("m", c.cast(picks.schema["channel"].dataType)), dt))
    row = row.withColumn("v", values)
    last = lambda s: F.least(s + PER_LINE - 1, F.lit(channels))
    body = F.transform(F.sequence(F.lit(1), F.lit(channels), F.lit(PER_LINE)), lambda s: F.concat(F.format_string("fb%13d%5d", s, last(s)), F.array_join(F.transform(F.slice("v", s, F.lit(PER_LINE)), lambda v: F.format_string("%5d", v)), "")))
    head = F.array(F.concat(F.lit(RECORD), F.format_string("%5d", "rec")))
    return row.select(*keys, "rec", F.posexplode(F.concat(head, body)).alias("line_no", "line"))


def write(picks: DataFrame, path: str, dt: float, channels: int) -> None:
    """One text folder per `file`; a file's lines are in one part, in order."""
    out = lines(picks, ["file"], dt, channels).repartition("file").sortWithinPartitions("file", "rec", "line_no")
    out.select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)


def read(spark: SparkSession, path: str, dt: float) -> DataFrame:
    """file, rec (order in the file, from 1), channel, sample (floor of time / dt; 0 for none), start, end, line_no."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    rec = F.count(F.when(F.col("line").startswith(RECORD), 1)).over(Window.partitionBy("file").orderBy("line_no"))
    fb = text.withColumn("rec", rec).where(F.col("line").startswith("fb"))
    number = lambda at, size: F.trim(F.substring("line", at, size)).try_cast("int")
    n = F.ceil((F.length("line") - 20) / 5).cast("int")
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.trim(F.substr(F.col("line"), k * 5 + 21, F.lit(5))).try_cast("int")))
    fb = fb.select("file", "rec", "line_no", number(3, 13).alias("start"), number(16, 5).alias("end"), F.posexplode(chunks).alias("k", "v"))
    sample = F.when(F.col("v").isNull() | (F.col("v") == NONE), F.lit(0)).otherwise(F.greatest(F.floor(F.col("v") / dt), F.lit(0)))
    return fb.select("file", "rec", (F.col("start") + F.col("k")).alias("channel"), sample.cast("int").alias("sample"), "start", "end", "line_no")


def faults(read_rows: DataFrame) -> DataFrame:
    """file, fault: blocks that do not follow each other, lines before a record, uneven records."""
    block = read_rows.groupBy("file", "rec", "line_no", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("end", 1).over(Window.partitionBy("file", "rec").orderBy("line_no"))
    gap = block.withColumn("due", F.coalesce(before, F.lit(0)) + 1)
    line = gap.select("file", F.when(F.col("rec") == 0, "line before the first record").when(F.col("start").isNull() | F.col("end").isNull(), "no channel range").when(F.col("start") != F.col("due"), "blocks do not follow").alias("fault"))
    size = block.groupBy("file", "rec").agg(F.sum("n").alias("n"), F.max("end").alias("top"))
    count = size.select("file", F.when(F.col("n") != F.col("top"), "values do not match channels").alias("fault"))
    even = size.groupBy("file").agg(F.when(F.min("top") != F.max("top"), "records differ in channels").alias("fault"))
    return line.unionByName(count).unionByName(even).where("fault is not null").distinct()
