"""The listing of a mail store as a data source of its own: tasks list, the driver holds prefixes only."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from mailtriage.sources.mail import file_system

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "mailtriage_objects"
BATCH_ROWS = 8192
SCHEMA = "key STRING, size LONG, last_modified TIMESTAMP, path STRING"
_ARROW = pa.schema(
    [("key", pa.string()), ("size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC")), ("path", pa.string())]
)


@dataclass
class Folder(InputPartition):
    """The objects of a folder below the root, with those of its folders if it is ``deep``."""

    name: str
    deep: bool


class ObjectListing(DataSource):
    """Options: ``root``; ``prefixes``, one a line: folders below the root, each listed by a task of its own. Without them
    the folders right below the root are, which the driver asks the store for."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectReader:
        named = self.options.get("prefixes")
        return ObjectReader(self.options["root"].rstrip("/"), None if named is None else named.split("\n"))


class ObjectReader(DataSourceReader):
    def __init__(self, root: str, prefixes: list[str] | None):
        self.root, self.prefixes = root, prefixes
        self.begin = ""  # what every key that is asked for begins with

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over conditions on how the key begins; equality narrows what is listed and is left to Spark besides."""
        for condition in filters:
            if isinstance(condition, StringStartsWith | EqualTo) and condition.attribute == ("key",):
                begin = condition.value
                if begin.startswith(self.begin):
                    self.begin = begin
                    if isinstance(condition, StringStartsWith):
                        continue
                elif isinstance(condition, StringStartsWith) and self.begin.startswith(begin):
                    continue
            yield condition

    def partitions(self) -> Sequence[Folder]:
        if self.prefixes is not None:
            return [Folder(p.strip("/"), True) for p in self.prefixes if self._may_hold(p.strip("/"))] or [Folder("", False)]
        base = self.begin.rpartition("/")[0]
        below = [x.base_name for x in self._entries(base) if x.type == fs.FileType.Directory]
        deep = [f"{base}/{name}" if base else name for name in sorted(below)]
        return [Folder(base, False), *(Folder(name, True) for name in deep if self._may_hold(name))]

    def _may_hold(self, folder: str) -> bool:
        inside = f"{folder}/" if folder else ""
        return inside.startswith(self.begin) or self.begin.startswith(inside)

    def _entries(self, folder: str) -> list[fs.FileInfo]:
        files, base = file_system(self.root)
        return files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True))

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        waiting, rows = [partition.name], []
        while waiting:
            folder = waiting.pop()
            for entry in self._entries(folder):
                key = f"{folder}/{entry.base_name}" if folder else entry.base_name
                if entry.type == fs.FileType.Directory:
                    if partition.deep and self._may_hold(key):
                        waiting.append(key)
                elif entry.type == fs.FileType.File and key.startswith(self.begin):
                    rows.append((key, entry.size, entry.mtime, f"{self.root}/{key}"))
                    if len(rows) == BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _ARROW.types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def list_store(spark: SparkSession, root: str, prefixes: Sequence[str] | None = None) -> DataFrame:
    """``key, size, last_modified, path`` of the objects below ``root``: the key is what follows it. One task lists each
    prefix, folder by folder, in Arrow batches; a filter on how the key begins is pushed into the listing. No object is
    opened. A store that is not there has no objects."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectListing)
    reader = spark.read.format(FORMAT).option("root", root)
    if prefixes is not None:
        reader = reader.option("prefixes", "\n".join(prefixes))
    return reader.load()
