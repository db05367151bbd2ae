"""What the corpus operators share: table access, lineage cuts, text maps, small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Word separators of every word count here: ASCII white space only.
SPACES = " \t\n\x0b\x0c\r"
#: Characters handed to a text function at once.
CHARS = 4_000_000
#: Whether Spark deletes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders written since a scratch block began; None outside of one.
_written: list[str] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only for a local master that has none set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/tracewell/{tag}-{uuid.uuid4().hex}"
    if _written is not None:
        _written.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more, wherever they are stored."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that operators write inside the block go at its end: results must be stored by then."""
    global _written
    outer, _written = _written, []
    try:
        yield
    finally:
        mine, _written = _written, outer
        remove(spark, *mine)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back; its shuffle files go."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, tag: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, stored; the folders that it wrote on the way go."""
    with scratch(spark):
        made = materialize(make(), tag)
        path = _written.pop()
    if _written is not None:
        _written.append(path)
    return made


def map_texts(docs: DataFrame, keep: list[str], prepare: Callable[[], Callable], made: str, look: tuple[str, ...] = (), chars: int = CHARS) -> DataFrame:
    """The columns to keep, and columns made (a DDL list) from the texts of docs.

    prepare() is called once a task and returns work(texts), which returns
    (positions, columns): for each row made, the position of its text, or None
    for one row a text, and a list of values for each column made. Kept columns
    stay Arrow data, so nulls and large integers come through as they are. Columns
    to look at go to work as Arrow arrays behind the texts. Texts are handed over
    in parts of about so many characters.
    """
    fields = T._parse_datatype_string(made).fields
    types = [to_arrow_type(f.dataType) for f in fields]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t"), *[F.col(c).alias(f"l{i}") for i, c in enumerate(look)])
    outer = T.StructType([T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField(f"m{i}", f.dataType) for i, f in enumerate(fields)])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for b in batches:
            texts, start, size = b.column(n_keep).to_pylist(), 0, 0
            for end, t in enumerate(texts, 1):
                size += len(t or "")
                if size < chars and end < len(texts):
                    continue
                positions, columns = work(texts[start:end], *(b.column(n_keep + 1 + i).slice(start, end - start) for i in range(len(look))))
                kept = [b.column(i).slice(start, end - start) for i in range(n_keep)]
                if positions is not None:
                    at = pa.array(positions, pa.int64())
                    kept = [c.take(at) for c in kept]
                data = [pa.array(c, ty) for c, ty in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(kept + data, outer.names)
                start, size = end, 0

    out = inner.mapInArrow(run, outer)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"m{i}").alias(f.name) for i, f in enumerate(fields)])


def shielded(docs: DataFrame) -> DataFrame:
    """docs with every column but doc_id and text renamed by its place, so that none can clash."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_c{k}") for k, c in enumerate(docs.columns)])


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, by name and order, from what was made of shielded(docs)."""
    return df.select(*[F.col(c if c in ("doc_id", "text") else f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the decimal id modulo mod; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(mod))


def hash_sample(rows: DataFrame, key: str, k: int) -> DataFrame:
    """About the k rows with the least hash of doc_id for each value of key, k at most.

    A first cut by hash keeps 4 k rows of a class on average, so that no task
    ranks a whole class.
    """
    from pyspark.sql import Window

    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    cut = rows.withColumn("_h", h).join(F.broadcast(size), key)  # one row a class
    cut = cut.where(F.col("_h").cast("double") * F.col("_size") <= float(4 * k * (1 << 30)))
    first = Window.partitionBy(key).orderBy("_h", "doc_id")
    return cut.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= k).drop("_h", "_size", "_rn")


def salted_rank(df: DataFrame, keys: list[str], order: list[str], salt: str, out: str) -> DataFrame:
    """Gapless 0-based rank inside keys, without gathering a key in one task.

    Rows are ranked inside (keys, salt); each salt then starts where the salts
    before it end. The table of starts has one row per key and salt.
    """
    from pyspark.sql import Window

    cells = df.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, salt, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, salt).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(inside))
    return ranked.join(cells, [*keys, salt]).withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long")).drop("_start", "_rn")
