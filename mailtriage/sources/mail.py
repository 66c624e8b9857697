"""Raw mail objects as a batch scan, an arrival stream or one by one, and the listing of a mail store."""

from __future__ import annotations

import re
import sys
from collections import deque
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 1 << 20  # of contents in one output batch, or one object that is larger
IN_FLIGHT = 8  # objects of a task that are opened at a time
TASKS_A_CORE = 4
BATCH_OBJECTS = 1 << 17  # of an arrival stream that does not say
LOOKUP_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LOOKUP_CACHE = "spark.sql.hive.filesourcePartitionFileCacheSize"

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as scans report it, with scheme and authority."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(found).toString()


def object_id(path: Column, root: str | None, spark: SparkSession) -> Column:
    """The path below ``root``; a path that does not begin with it stays whole."""
    if root is None:
        return path
    start = _qualified(spark, root).rstrip("/") + "/"
    below = F.substring(path, F.lit(len(start) + 1), F.length(path))
    return F.when(F.startswith(path, F.lit(start)), below).otherwise(path)


def _as_mail(files: DataFrame, root: str | None) -> DataFrame:
    key = object_id(F.col("path"), root, files.sparkSession)
    return files.select(
        key.alias("msg_id"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
        "content",
    )


def scan_mail(
    spark: SparkSession, paths: str | Sequence[str], glob: str = "*", root: str | None = None
) -> DataFrame:
    """One row per stored object: ``msg_id`` (path, relative to ``root`` if given), ``size``,
    ``last_modified``, ``content``. Columns that are not used are not read, so a listing never opens
    a mail. The driver holds the listing of what is scanned: a backfill of a very large store goes prefix by prefix, and
    jobs that know their objects use :func:`read_objects`, which lists nothing."""
    reader = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    )
    return _as_mail(reader.load(paths if isinstance(paths, str) else list(paths)), root)


def scan_listing(
    spark: SparkSession, paths: str | Sequence[str], glob: str = "*", root: str | None = None
) -> DataFrame:
    """``msg_id, path, size, last_modified`` of the stored objects: where :func:`read_objects` finds them. No object
    is opened; Spark's scan would start a task for every few of them, so it is dealt as :func:`spread` says."""
    reader = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    )
    files = reader.load(paths if isinstance(paths, str) else list(paths)).coalesce(spread(spark))
    return files.select(
        object_id(F.col("path"), root, spark).alias("msg_id"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
    )


def stream_mail(
    spark: SparkSession, path: str, glob: str = "*", root: str | None = None, max_files: int | None = BATCH_OBJECTS
) -> DataFrame:
    """Every object that arrives under ``path``, once, in the shape of :func:`scan_mail`, in batches of ``max_files``: the
    driver holds what it has looked up of a batch, which must not grow with the store. The source looks up each new
    object of a batch again, in up to 10,000 tasks of a few objects each: the session is set to no more of them than
    :func:`spread` says, and to keep nothing of what it has looked up, as no object is asked for twice."""
    spark.conf.set(LOOKUP_CACHE, "0")
    spark.conf.set(LOOKUP_TASKS, str(min(int(spark.conf.get(LOOKUP_TASKS)), spread(spark))))
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _as_mail(reader.load(path), root)


def spread(spark: SparkSession) -> int:
    """Over how many tasks objects are opened that are many and small: by the session's settings and cores, not by the
    bytes of their rows, which say nothing of the objects, nor a task for each few files."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)


def listing(mail: DataFrame) -> DataFrame:
    """The object listing of scanned mail: ``key``, ``size``, ``last_modified``; no mail is opened."""
    return mail.select(F.col("msg_id").alias("key"), "size", "last_modified")


def read_objects(
    wanted: DataFrame,
    path_col: str = "path",
    keep: Sequence[str] = ("msg_id",),
    tasks: int | None = None,
    in_flight: int = IN_FLIGHT,
) -> DataFrame:
    """The ``keep`` columns with ``content`` and ``read_error`` of the objects at ``path_col``, opened one by one in
    tasks through Arrow's file systems: nothing is listed, and no other object is touched. An object that cannot be
    read, or a null path, gives a null content and says why. ``tasks`` spreads the paths, never the contents. A task has
    up to ``in_flight`` objects on their way and sends on what it has as soon as that reaches ``BATCH_BYTES``."""
    keep = list(keep)
    picked = wanted.select(*keep, F.col(path_col).cast("string").alias("_path"))
    if tasks:
        picked = picked.repartition(tasks)
    added = [T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())]
    schema = T.StructType([*(picked.schema[name] for name in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                start, size, found = 0, 0, []
                for content, error in _in_order(pool, batch.column(len(keep)).to_pylist(), in_flight):
                    found.append((content, error))
                    size += len(content or b"")
                    if size >= BATCH_BYTES:
                        yield _with_contents(batch.slice(start, len(found)), keep, found)
                        start, size, found = start + len(found), 0, []
                if found:
                    yield _with_contents(batch.slice(start, len(found)), keep, found)

    return picked.mapInArrow(run, schema)


def _in_order(pool: ThreadPoolExecutor, paths: list, in_flight: int) -> Iterator[tuple[bytes | None, str | None]]:
    """Objects in the order of their paths, no more than ``in_flight`` of them ahead of what is taken."""
    waiting: deque = deque()
    for path in paths:
        waiting.append(pool.submit(_read_object, path))
        if len(waiting) >= in_flight:
            yield waiting.popleft().result()
    while waiting:
        yield waiting.popleft().result()


def _with_contents(part: pa.RecordBatch, keep: list[str], found: list[tuple]) -> pa.RecordBatch:
    contents, errors = zip(*found, strict=True)
    arrays = [pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *arrays], [*keep, "content", "read_error"])


def _read_object(path: str | None) -> tuple[bytes | None, str | None]:
    if path is None:
        return None, "no path"
    try:
        files, name = file_system(path)
        with files.open_input_stream(name) as stream:
            return stream.read(), None
    except FileNotFoundError:
        return None, f"no such object: {path}"
    except Exception as problem:
        return None, f"{type(problem).__name__}: {problem}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path in it. A local path is taken as it is, without URL decoding."""
    name = re.sub(r"^s3[an]:", "s3:", path)
    scheme = re.match(r"([a-z][a-z0-9+.-]*):", name)
    if scheme is None or scheme[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", name)
    return fs.FileSystem.from_uri(name)
