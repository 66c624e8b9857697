"""Triage of every mail that arrives, or that an event tells of, batch by batch, into tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailtriage.config import TriageConfig
from mailtriage.operators.scoring import ScorerFactory, responses_among
from mailtriage.plans.outputs import batch_folder, write_outputs
from mailtriage.plans.triage import decide, decide_light, light_mail, read_mail, read_notified
from mailtriage.sources.mail import spread


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint. It stays the same when the query is started again."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def triage_stream(
    arrivals: DataFrame,
    cfg: TriageConfig,
    out: str,
    checkpoint: str,
    responses: Callable[[SparkSession], DataFrame] | None = None,
    make_scorer: ScorerFactory | None = None,
    run_ts: Column | None = None,
    interval: str | None = None,
    tasks: int | None = None,
    id_col: str = "msg_id",
    wait: int = 0,
) -> StreamingQuery:
    """Start the query. ``arrivals`` is a stream of ``msg_id, content``. ``responses`` is called per
    batch, so that the table is read as it is by then. Without an ``interval`` all mail that is there
    is processed and the query ends. ``tasks`` spreads each batch over that many tasks, for sources
    whose batches have few splits; without it mail is parsed where it is read, in no more tasks than
    :func:`spread` says: a scan of many small objects would start one, with a parser of its own, for every few of them.

    A mail without any response row, not even an error, may ``wait`` for that many later batches in the
    ``pending`` table before it is answered without one.

    Each batch runs the batch job on its own rows. Its folders are named by the query's id, which the
    checkpoint keeps, and by its number: a repeated batch replaces its output instead of adding to it, and
    another query, or this one with a new checkpoint, never touches it. Readers see a batch once all its tables are
    written. ``run_ts`` dates prompts and tickets; without it a repeated batch is dated anew."""

    def assemble(batch: DataFrame) -> DataFrame:
        dealt = batch.coalesce(spread(batch.sparkSession)) if tasks is None else batch.repartition(tasks)
        return read_mail(dealt, cfg, id_col)

    return _start(arrivals, assemble, cfg, out, checkpoint, responses, make_scorer, run_ts, interval, id_col, wait)


def event_stream(
    events: DataFrame,
    cfg: TriageConfig,
    locate: Callable[[Column, Column], Column],
    out: str,
    checkpoint: str,
    responses: Callable[[SparkSession], DataFrame] | None = None,
    make_scorer: ScorerFactory | None = None,
    run_ts: Column | None = None,
    interval: str | None = None,
    tasks: int | None = None,
    id_col: str = "msg_id",
    event_col: str = "event",
    wait: int = 0,
) -> StreamingQuery:
    """As :func:`triage_stream`, but ``events`` is a stream of object-created notifications, from any source: each is an
    id and the JSON text. The objects of a batch are opened by the paths that ``locate`` makes of bucket and key, in
    tasks; no store is listed, and what was there before the events is not touched. Every event has a row, as every
    notification is acted on: an object told of twice is triaged twice, an event that cannot be read or whose object
    cannot is an error with its reason. A batch that is repeated replaces its rows. Of the ``responses`` only those that
    a batch may ask for are shuffled: a stream of many batches does not move the whole table for each."""

    def assemble(batch: DataFrame) -> DataFrame:
        return read_notified(batch, cfg, locate, id_col, event_col, tasks)

    return _start(events, assemble, cfg, out, checkpoint, responses, make_scorer, run_ts, interval, id_col, wait, True)


def _start(
    arrivals: DataFrame,
    assemble: Callable[[DataFrame], DataFrame],
    cfg: TriageConfig,
    out: str,
    checkpoint: str,
    responses: Callable[[SparkSession], DataFrame] | None,
    make_scorer: ScorerFactory | None,
    run_ts: Column | None,
    interval: str | None,
    id_col: str,
    wait: int,
    light_source: bool = False,
) -> StreamingQuery:
    """``light_source``: the ids of a batch can be read again without its mail, to pick the responses it asks for."""
    if (responses is None) == (make_scorer is None):
        raise ValueError("give either a responses table or a scorer")
    if wait and responses is None:
        raise ValueError("only answers from a responses table can be waited for")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = F.current_timestamp() if run_ts is None else run_ts
        name = run_of(spark, checkpoint)
        if not wait:
            table = None if responses is None else responses(spark)
            if table is not None and light_source:
                table = responses_among(table, batch.select(id_col), id_col)
            decided = decide(assemble(batch), cfg, table, make_scorer, F.to_date(now), id_col)
            write_outputs(decided, cfg, out, now, name, batch_id, id_col=id_col)
            return
        light = light_mail(assemble(batch), cfg, id_col).withColumn("waited", F.lit(0))
        if batch_id:
            earlier = spark.read.schema(light.schema).parquet(batch_folder(out, "pending", name, batch_id - 1))
            light = light.unionByName(earlier.withColumn("waited", F.col("waited") + 1))
        inbox = batch_folder(out, "inbox", name, batch_id)
        light.write.mode("overwrite").parquet(inbox)
        light = spark.read.schema(light.schema).parquet(inbox)
        table = responses(spark)
        due = F.col("error").isNotNull() | (F.col("waited") >= wait)
        known = table.select(id_col).distinct()
        ready = light.where(due).unionByName(light.where(~due).join(known, id_col, "left_semi"))
        decided = decide_light(ready, cfg, responses_among(table, light.select(id_col), id_col), id_col)
        folders = write_outputs(decided, cfg, out, now, name, batch_id, id_col=id_col)
        # What is still open goes by what was written: a response that came meanwhile loses no mail.
        done = spark.read.parquet(folders["triage"]).select(id_col)
        still = light.join(done, id_col, "left_anti")
        still.write.mode("overwrite").parquet(batch_folder(out, "pending", name, batch_id))

    writer = arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
