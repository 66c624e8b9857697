"""What the operators share: their input columns, tables written between jobs, work in Arrow batches."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtriage.sources.workspace import shuffles_removed, workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 2 << 20


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` alone, whatever else the table holds; a null text counts as empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def written(table: DataFrame, name: str, *partition_by: str, compression: str | None = None) -> DataFrame:
    """The table after a write to the shared folder: cuts the lineage, and survives lost executors. What the write has
    shuffled leaves the disks with it."""
    path = workspace(table.sparkSession, name)
    writer = table.write.partitionBy(*partition_by) if partition_by else table.write
    writer = writer.option("compression", compression) if compression else writer
    with shuffles_removed(table.sparkSession):
        writer.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text_at: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE_BYTES`` of text, or of one text that is longer, so that what a task derives from a
    batch stays small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(text_at(batch)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def fold_of(doc_id: int | None, folds: int) -> int:
    """crc32 of the id as text, modulo the folds; a missing id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fold_column(doc_id, folds: int):
    """:func:`fold_of` as a native expression."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
