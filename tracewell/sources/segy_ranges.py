"""SEG-Y by byte ranges: a data source, a scan of listed files, and a table of headers.

All traces of a file have one length, so any byte range knows its traces: those that
begin inside it. Ranges are cut by file length alone; no file is opened to plan them.
A scan of headers seeks from header to header and leaves the samples unread.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewell.sources import segy

HEAD = segy.TEXT + segy.BINARY
SPLIT = 64 << 20
#: Bytes read at once, and samples' bytes a trace from which a header scan seeks over them.
CHUNK, GAP = 8 << 20, 1024
HEADERS = "file string, trace_idx long, " + ", ".join(f"{k} int" for k in segy.FIELDS) + ", dt_us int"
SUFFIXES = ("*.sgy", "*.segy")


def opened(path: str):
    """A file for reading without a buffer, on any store that Arrow knows."""
    if path.startswith("file:") or "://" not in path:
        return open(local(path), "rb", buffering=0)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def local(path: str) -> str:
    """The path of a file: URI; percent signs are undone as in URIs."""
    from urllib.parse import unquote

    if not path.startswith("file:"):
        return path
    return "/" + unquote(path[5:]).lstrip("/")


def read_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    parts, got = [], 0
    while got < n:
        part = f.read(n - got)
        if not part:
            raise ValueError("the file ends inside a trace")
        parts.append(part)
        got += len(part)
    return b"".join(parts)


def usable(fields: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Fields inside the trace header; cmp and offset_m may lie outside, others may not."""
    inside = {k: (p, w) for k, (p, w) in fields.items() if p >= 1 and p - 1 + w <= segy.TRACE}
    lost = set(segy.FIELDS) - set(inside) - {"cmp", "offset_m"}
    if lost:
        raise ValueError(f"no such place in a trace header: {sorted(lost)}")
    return inside


def range_batches(path: str, begin: int, end: int, big: bool = True, headers_only: bool = False, fields: dict[str, tuple[int, int]] | None = None, first: int = 0, last: int | None = None) -> Iterator[pa.RecordBatch]:
    """The traces (first to last of the file at most) that begin in bytes begin to end - 1.

    Of a field without a place in the header, offset_m is 0 and cmp null.
    """
    inside = usable(fields or segy.FIELDS)
    schema = pa.schema([("file", pa.string()), ("trace_idx", pa.int64()), *[(k, pa.int32()) for k in segy.FIELDS], ("dt_us", pa.int32())] + ([] if headers_only else [("samples", pa.list_(pa.float32()))]))
    with opened(path) as f:
        dt, ns, kind = segy.layout(read_at(f, 0, HEAD), big)
        size, total = segy.TRACE + 4 * ns, f.seek(0, 2)
        if (total - HEAD) % size:
            raise ValueError(f"{path} does not hold whole traces")
        at_or_after = lambda b: max(0, -(-(b - HEAD) // size))
        start, stop = max(at_or_after(begin), first), min(at_or_after(end), (total - HEAD) // size, (total if last is None else last + 1))
        step = max(1, CHUNK // size)
        for at in range(start, stop, step):
            n = min(step, stop - at)
            if headers_only and 4 * ns > GAP:
                raw = b"".join([read_at(f, HEAD + k * size, segy.TRACE) for k in range(at, at + n)])
            else:
                raw = read_at(f, HEAD + at * size, n * size)
            rows = np.frombuffer(raw, np.uint8).reshape(n, -1)
            found = segy.header_columns(rows, big, inside)
            columns = {"file": pa.array([path] * n), "trace_idx": pa.array(np.arange(at, at + n)), "dt_us": pa.array(np.full(n, dt, np.int32))}
            columns |= {k: pa.array(found[k]) if k in found else pa.array([0 if k == "offset_m" else None] * n, pa.int32()) for k in segy.FIELDS}
            if not headers_only:
                values = segy.sample_rows(rows, kind, big)
                columns["samples"] = pa.ListArray.from_arrays(pa.array(np.arange(0, n * ns + 1, ns) if ns else np.zeros(n + 1), pa.int32()), pa.array(values.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([columns[c].cast(schema.field(c).type) for c in schema.names], schema=schema)


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def found_files(root: str) -> Iterator[tuple[str, int]]:
    """(path, length) of the files under a folder, or of a single file."""
    if root.startswith("file:") or "://" not in root:
        top = local(root)
        names = [top] if os.path.isfile(top) else sorted(os.path.join(d, x) for d, _, files in os.walk(top) for x in files)
        yield from ((x, os.path.getsize(x)) for x in names if any(fnmatch(x, s) for s in SUFFIXES))
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(root)
    at = store.get_file_info(inner)
    infos = [at] if at.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = root.split("://")[0]
    yield from ((f"{scheme}://{x.path}", x.size) for x in infos if x.is_file and any(fnmatch(x.path, s) for s in SUFFIXES))


class SegyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.big = options.get("endian", "big") == "big"
        self.headers_only = options.get("headersonly", "false").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT))
        self.first, self.last = int(options.get("firsttrace", 0)), options.get("lasttrace")

    def partitions(self) -> list[Range]:
        return [Range(p, at, min(at + self.split, n)) for p, n in found_files(self.path) for at in range(0, n, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from range_batches(part.path, part.begin, part.end, self.big, self.headers_only, None, self.first, None if self.last is None else int(self.last))


class SegyDataSource(DataSource):
    """spark.dataSource.register(SegyDataSource); spark.read.format("segy").load(folder).

    Options: endian (big or little), headersOnly, splitBytes, firstTrace and lastTrace (of every file).
    """

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return HEADERS if {k.lower(): v for k, v in self.options.items()}.get("headersonly", "false").lower() == "true" else segy.SCHEMA

    def reader(self, schema: T.StructType) -> SegyReader:
        return SegyReader({k.lower(): v for k, v in self.options.items()})


def listing(spark: SparkSession, path: str) -> DataFrame:
    """file, modified, length of every SEG-Y file under path; nothing is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{sgy,segy}").load(path)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length")


def scan(files: DataFrame, big: bool = True, headers_only: bool = False, split: int = SPLIT, fields: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The traces of listed files (file, length): every range of split bytes is dealt out on its own."""
    spark = files.sparkSession
    ranges = files.where("length > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("begin"))
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from range_batches(path, begin, begin + split, big, headers_only, fields)

    return dealt.mapInArrow(run, HEADERS if headers_only else segy.SCHEMA)


def cached_headers(spark: SparkSession, path: str, cache: str, big: bool = True, split: int = SPLIT, fields: dict[str, tuple[int, int]] | None = None, rebuild: bool = False) -> DataFrame:
    """Trace headers of all files under path, from the table in the folder cache as far as it holds them.

    A file counts as held if its time and length are those of its last scan; others
    are scanned and appended, rows of former versions are passed over. Byte order
    and field places have tables of their own. One job at a time may write a table.
    """
    places = {**segy.FIELDS, **(fields or {})}
    at = f"{cache}/{'big' if big else 'little'}-{zlib.crc32(repr(sorted(places.items())).encode()):08x}"
    schema = f"{HEADERS}, modified timestamp, length long"
    files, same = listing(spark, path), ["file", "modified", "length"]
    wanted = files
    if not rebuild:
        try:
            held = spark.read.schema(schema).parquet(at).where("trace_idx = 0").select(*same)
            wanted = files.join(held, same, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if rebuild or not wanted.isEmpty():
        fresh = scan(wanted, big, True, split, places).join(files, "file")
        fresh.write.mode("overwrite" if rebuild else "append").parquet(at)
    return spark.read.schema(schema).parquet(at).join(files, same, "left_semi").drop("modified", "length")
