"""Where a job may keep written tables and stream checkpoints."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A session without that setting is refused, unless it
    has no executors of its own (``local[...]``, as in tests): a folder of one machine is not seen by others."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="mailtriage-")


def _of_application(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder path for one run, under the application's own folder in the shared one."""
    return f"{_of_application(spark)}/{name}-{uuid.uuid4().hex}"


def clear_workspace(spark: SparkSession) -> None:
    """Delete what the application has kept in the shared folder, once its results are written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_of_application(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For jobs that write a table: what a job has shuffled leaves the disks when the job ends. Otherwise it stays until
    the driver happens to collect its garbage, and a plan of many jobs holds the shuffles of all of them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
