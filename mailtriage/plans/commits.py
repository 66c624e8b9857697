"""Commit records: which written folders hold the rows that readers may see.

A record names the batches it covers and, for each table, the folder with their rows. It is one small JSON file that
appears under its final name in one step, after all its folders are complete. For a batch that several records cover, a
later record counts: so a repeated batch, or a compaction, takes the place of what was there for all tables at once."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORD = (
    "seq bigint, id string, batches array<struct<run: string, batch_id: bigint>>, folders map<string, string>, "
    "schemas map<string, string>, counts map<string, bigint>"
)


@dataclass(frozen=True)
class Committed:
    """A folder set with the batches that count in it; ``whole`` if those are all that it holds."""

    record: str
    batches: tuple[tuple[str, int], ...]
    folders: dict[str, str]
    schemas: dict[str, str]
    counts: dict[str, int]
    whole: bool


def _files(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, files = _files(spark, path)
    return files.exists(found)


def size_of(spark: SparkSession, path: str) -> int:
    found, files = _files(spark, path)
    return files.getContentSummary(found).getLength()


def delete(spark: SparkSession, path: str) -> None:
    found, files = _files(spark, path)
    files.delete(found, True)


def _records(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_RECORD).json(f"{out}/commits/*.json")


def commit(
    spark: SparkSession,
    out: str,
    batches: list[tuple[str, int]],
    folders: dict[str, str],
    schemas: dict[str, str],
    counts: dict[str, int],
) -> None:
    """Publish the folders: written aside first, then renamed."""
    last = _records(spark, out).agg(F.max("seq")).first()[0] if exists(spark, f"{out}/commits") else None
    name = uuid.uuid4().hex
    record = {
        "seq": (last or 0) + 1,
        "id": name,
        "batches": [{"run": run, "batch_id": batch} for run, batch in batches],
        "folders": folders,
        "schemas": schemas,
        "counts": counts,
    }
    aside, files = _files(spark, f"{out}/commits/_{name}")
    stream = files.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(record).encode()))
    finally:
        stream.close()
    final, _ = _files(spark, f"{out}/commits/{record['seq']:012d}-{name}.json")
    if not files.rename(aside, final):
        raise OSError(f"the commit record {final.toString()} could not be put in place")


def committed(spark: SparkSession, out: str) -> list[Committed]:
    """What counts now, in the order of the records; the driver holds a row for each batch."""
    if not exists(spark, f"{out}/commits"):
        return []
    records = _records(spark, out)
    covered = records.select("seq", "id", F.explode("batches").alias("batch")).select("seq", "id", "batch.*")
    live = covered.groupBy("run", "batch_id").agg(F.max(F.struct("seq", "id")).alias("by"))
    live = live.groupBy("by.id").agg(F.sort_array(F.collect_list(F.struct("run", "batch_id"))).alias("live"))
    rows = records.join(live, "id").orderBy("seq", "id").collect()
    return [
        Committed(
            r.id,
            tuple((b.run, b.batch_id) for b in r.live),
            r.folders,
            r.schemas,
            r.counts,
            len(r.live) == len(r.batches),
        )
        for r in rows
    ]
