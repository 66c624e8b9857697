"""Scoring that can be taken up again: a ledger of answers, written while they come in."""

from __future__ import annotations

import functools
import io
import sys
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailtriage.operators.scoring import ScorerFactory, _answer
from mailtriage.sources.mail import file_system

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 256
FLUSH = 256  # answers that a task keeps before it writes them


class Bucket:
    """The answers of one hash bucket: what its files hold when it is opened, and what is added."""

    def __init__(self, ledger: str, number: int, id_col: str, kind: pa.DataType, flush: int):
        self.files, base = file_system(ledger)
        self.folder, self.id_col, self.kind, self.flush = f"{base}/bucket={number}", id_col, kind, flush
        self.rows: list[tuple] = []
        self.answered: set = set()
        for entry in self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if entry.base_name.endswith(".parquet"):
                with self.files.open_input_file(entry.path) as source:
                    self.answered.update(pq.read_table(source, columns=[id_col]).column(0).to_pylist())

    def add(self, own_id, body: str | None, code: str | None) -> None:
        self.rows.append((own_id, body, code))
        if len(self.rows) >= self.flush:
            self.write()

    def write(self) -> None:
        """A file appears under its name when it is complete."""
        if not self.rows:
            return
        columns = zip(*self.rows, strict=True)
        names, kinds = [self.id_col, "body", "error_code"], [self.kind, pa.string(), pa.string()]
        table = pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})
        held = io.BytesIO()
        pq.write_table(table, held)
        self.files.create_dir(self.folder, recursive=True)
        name = uuid.uuid4().hex
        with self.files.open_output_stream(f"{self.folder}/_{name}") as out:
            out.write(held.getvalue())
        self.files.move(f"{self.folder}/_{name}", f"{self.folder}/{name}.parquet")
        self.answered.update(r[0] for r in self.rows)
        self.rows = []


def score_once(
    requests: DataFrame,
    make_scorer: ScorerFactory,
    ledger: str,
    id_col: str = "msg_id",
    model_id: str | None = None,
    in_flight: int = 1,
    buckets: int = BUCKETS,
    flush: int = FLUSH,
    keep_errors: bool = False,
) -> DataFrame:
    """Score what the ``ledger`` has no answer for, and return the answers to these requests: ``body`` and ``error_code``
    by id, once each.

    Requests (``request`` by id) are shuffled once, into the hash buckets of the ledger, which is never shuffled: the task
    that gets a bucket reads the ids its files hold, asks for the others, and writes answers every ``flush`` of them and
    when it ends, also when it fails. So a task that is tried again, or a job that is run again, asks for no id twice that
    has an answer; a machine that is lost loses at most ``flush`` answers of each of its tasks. ``buckets`` belongs to
    the ledger: it has to be the same in each run, and such that the ids of one bucket fit a task. Repeated requests for
    an id are one. A refusal is no answer unless ``keep_errors``: a later run asks again, and this one returns the
    refusal as ``error_code``; whatever else a scorer does wrong leaves the id without an answer."""
    bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")
    asked = requests.where(F.col("request").isNotNull()).select(id_col, "request", bucket.alias("bucket"))
    dealt = asked.repartition("bucket").sortWithinPartitions("bucket", id_col)
    schema = T.StructType(
        [asked.schema[id_col], T.StructField("body", T.StringType()), T.StructField("error_code", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Bucket | None = None
        number, before, refused = None, None, []
        waiting: deque = deque()
        score: Callable | None = None

        def take() -> None:
            own_id, future = waiting.popleft()
            body, code = future.result()
            if body is not None or (keep_errors and code is not None):
                own.add(own_id, body, code)
            elif code is not None:
                refused.append((own_id, None, code))

        with ThreadPoolExecutor(in_flight) as pool:
            try:
                for batch in batches:
                    rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
                    for own_id, request, at in rows:
                        if at != number:
                            while waiting:
                                take()
                            if own:
                                own.write()
                            own = Bucket(ledger, at, id_col, batch.schema.field(id_col).type, flush)
                            number, before = at, None
                        if own_id in own.answered or (before is not None and own_id == before[0]):
                            continue
                        before = (own_id,)
                        score = score or make_scorer(model_id)
                        waiting.append((own_id, pool.submit(functools.partial(_answer, score), request)))
                        if len(waiting) >= in_flight:
                            take()
                while waiting:
                    take()
            finally:
                if own:
                    own.write()
        if refused:
            kinds = [own.kind, pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*refused, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "body", "error_code"])

    folder = f"{ledger}-refused/{uuid.uuid4().hex}"
    dealt.select(id_col, "request", "bucket").mapInArrow(run, schema).write.parquet(folder)
    spark = requests.sparkSession
    known = read_ledger(spark, ledger, schema).unionByName(spark.read.schema(schema).parquet(folder))
    return known.join(asked.select(id_col), id_col, "left_semi")


def read_ledger(spark: SparkSession, ledger: str, schema: T.StructType) -> DataFrame:
    """All answers in the ledger; none if it is not there yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger)
