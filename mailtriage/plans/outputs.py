"""The tables a triage leaves behind."""

from __future__ import annotations

import functools
import json
import math
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailtriage.config import TriageConfig
from mailtriage.operators.report import build_outbox, build_status, build_tickets
from mailtriage.plans.commits import Committed, commit, committed, delete, size_of
from mailtriage.sources.workspace import shuffles_removed

TABLES = ("triage", "outbox", "tickets", "status")
FILE_BYTES = 128 << 20


def checked_run(run: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run):
        raise ValueError(f"a run is named by letters, digits, dots, dashes and underscores, not {run!r}")
    return run


def batch_folder(out: str, table: str, run: str, batch: int) -> str:
    """The folder that a batch of a run owns in a table of a stream's own."""
    return f"{out}/{table}/run={checked_run(run)}/batch_id={int(batch)}"


def write_outputs(
    triaged: DataFrame,
    cfg: TriageConfig,
    out: str,
    run_ts: Column,
    run: str,
    batch: int,
    is_html: bool = True,
    id_col: str = "msg_id",
) -> dict[str, str]:
    """Write the decided rows once, then derive replies, tickets and outcomes from the written table, so mail is parsed
    and scored once; then publish the four tables together by a commit record. Until then readers see nothing of the
    batch, or what it was before: writing it again replaces it, and other runs are not touched. ``run`` names the job for
    good: a repeat under another name adds its rows again. The record holds how many mails succeeded and failed, counted
    by the job that wrote them. Returns the folders."""
    attempt = f"{checked_run(run)}-{int(batch)}-{uuid.uuid4().hex}"
    folders = {table: f"{out}/{table}/{attempt}" for table in TABLES}
    schemas = {}

    def write(table: str, rows: DataFrame) -> None:
        rows = rows.withColumns({"run": F.lit(run), "batch_id": F.lit(int(batch)).cast("long")})
        with shuffles_removed(rows.sparkSession):
            rows.write.parquet(folders[table])
        schemas[table] = rows.schema.json()

    seen = Observation()
    failed = F.col("error").isNotNull()
    write("triage", triaged.observe(seen, F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed")))
    decided = triaged.sparkSession.read.schema(triaged.schema).parquet(folders["triage"])
    keep = (id_col,)
    write("outbox", build_outbox(decided, cfg, is_html, keep))
    write("tickets", build_tickets(decided, cfg, run_ts, keep))
    write("status", build_status(decided, keep))
    commit(triaged.sparkSession, out, [(run, int(batch))], folders, schemas, dict(seen.get))
    return folders


def _of(sets: Sequence[Committed], table: str, spark: SparkSession) -> DataFrame:
    """The rows of a table that count in some folder sets."""
    schema = T.StructType.fromJson(json.loads(sets[-1].schemas[table]))
    reader = spark.read.schema(schema)
    whole = [s.folders[table] for s in sets if s.whole]
    parts = [reader.parquet(*whole)] if whole else []
    for s in sets:
        if not s.whole:
            of_batch = functools.reduce(
                Column.__or__, ((F.col("run") == run) & (F.col("batch_id") == batch) for run, batch in s.batches)
            )
            parts.append(reader.parquet(s.folders[table]).where(of_batch))
    return functools.reduce(DataFrame.unionByName, parts)


def read_output(spark: SparkSession, out: str, table: str) -> DataFrame:
    """One of the written tables, all runs and committed batches, with ``run`` and ``batch_id``."""
    if table not in TABLES:
        raise ValueError(f"no table {table!r}; there are {', '.join(TABLES)}")
    sets = committed(spark, out)
    if not sets:
        raise ValueError(f"no batch is committed in {out}")
    return _of(sets, table, spark)


def read_counts(spark: SparkSession, out: str) -> list[tuple[tuple[tuple[str, int], ...], dict[str, int]]]:
    """For each committed set of batches how many of their mails succeeded and failed; no table is read."""
    return [(s.batches, s.counts) for s in committed(spark, out)]


def compact(spark: SparkSession, out: str, run: str, target_bytes: int = FILE_BYTES, newest: int = 1) -> int:
    """Rewrite the small folders of a run into files of about ``target_bytes`` and put them in the place of the folders by
    one commit record; readers see the one or the other. The ``newest`` batches are left, as a stream may repeat its
    last one. Returns how many folder sets were replaced."""
    sets = [s for s in committed(spark, out) if all(own == run for own, _ in s.batches)]
    last = sorted({batch for s in sets for _, batch in s.batches})[-newest:] if newest else []
    sizes = {s.record: size_of(spark, s.folders["triage"]) for s in sets}
    old = [s for s in sets if sizes[s.record] < target_bytes and not any(batch in last for _, batch in s.batches)]
    if len(old) < 2:
        return 0
    batches = sorted(b for s in old for b in s.batches)
    attempt = f"{run}-{batches[0][1]}-{batches[-1][1]}-{uuid.uuid4().hex}"
    folders = {table: f"{out}/{table}/{attempt}" for table in TABLES}
    for table in TABLES:
        size = sum(size_of(spark, s.folders[table]) for s in old)
        _of(old, table, spark).repartition(max(1, math.ceil(size / target_bytes))).write.parquet(folders[table])
    whole = all(s.whole for s in old)
    names = sorted({name for s in old for name in s.counts}) if whole else []
    counts = {name: sum(s.counts.get(name, 0) for s in old) for name in names}
    commit(spark, out, batches, folders, old[-1].schemas, counts)
    return len(old)


def clear_replaced(spark: SparkSession, out: str) -> int:
    """Delete written folders that no committed batch is in. Only for when nothing writes or reads there: a batch that is
    being written is not committed yet, and a reader may have planned on what was replaced. Returns how many went."""
    live = {folder.rsplit("/", 1)[1] for s in committed(spark, out) for folder in s.folders.values()}
    gone = 0
    for table in TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{table}")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            continue
        for status in files.listStatus(path):
            if status.isDirectory() and status.getPath().getName() not in live:
                delete(spark, status.getPath().toString())
                gone += 1
    return gone
