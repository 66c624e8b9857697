"""Model scoring as a batch enrichment: prompts, requests, responses. No model is called from here."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailtriage import constants as k
from mailtriage.config import TriageConfig
from mailtriage.templates import fill

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEWEST_MARKS = 1 << 16  # bits
MOST_MARKS = 1 << 26

# A scorer takes the JSON request of one message and returns the JSON body of the model's response. Its factory
# gets the configured model id, runs once per task, and may be called by several threads' scorers at a time.
Scorer = Callable[[str], str]
ScorerFactory = Callable[[str | None], Scorer]


class ServiceError(Exception):
    """For scorers to raise when the model service refuses a request. It is told from other failures by
    its ``service_code``, so an exception class of the scorer's own with that attribute will do as well."""

    def __init__(self, service_code: str) -> None:
        super().__init__(service_code)
        self.service_code = service_code


def prompt(envelope: Column, run_date: Column, cfg: TriageConfig) -> Column:
    return fill(cfg.prompt_template, today=F.date_format(run_date, "MMMM dd, yyyy"), mail=envelope)


def build_prompts(mail: DataFrame, run_date: Column, cfg: TriageConfig) -> DataFrame:
    """Adds ``prompt``; null for a mail that could not be processed."""
    return mail.withColumn("prompt", prompt(F.col("envelope"), run_date, cfg))


def build_requests(prompts: DataFrame, cfg: TriageConfig) -> DataFrame:
    """Adds ``request``, the JSON payload for the model; null where ``prompt`` is null."""
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    payload = F.struct(
        F.lit(k.REQUEST_VERSION).alias(k.REQUEST_VERSION_FIELD),
        F.lit(cfg.max_tokens).alias("max_tokens"),
        F.lit(cfg.temperature).alias("temperature"),
        F.array(message).alias("messages"),
    )
    return prompts.withColumn("request", F.when(F.col("prompt").isNotNull(), F.to_json(payload)))


def single_responses(responses: DataFrame, on: str = "msg_id") -> DataFrame:
    """One response per message, as one message is scored once: a body beats an error, then the
    greatest value wins, so a table with repeats (a rerun scoring job) gives one stable answer.

    Repeats are folded before the shuffle. Grouping by the key and its hash keeps the result from being
    partitioned by the key alone: a join on the key then shuffles both sides itself, which is what lets
    adaptive execution split a message id that fills many mail rows."""
    best = F.max(F.struct(F.col("error_code").isNull().alias("ok"), "body", "error_code"))
    folded = responses.groupBy(on, F.xxhash64(on).alias("_hash")).agg(best.alias("_best"))
    return folded.select(on, "_best.body", "_best.error_code")


def responses_among(responses: DataFrame, ids: DataFrame, on: str = "msg_id") -> DataFrame:
    """The responses to the messages in ``ids``, and a few others: those whose id falls on a marked bit of a map that
    the ids mark. Bodies that a batch does not ask for are dropped where they are read, before any shuffle. The map has
    sixteen bits an id, up to ``MOST_MARKS``, which bounds the broadcast; beyond that more is let through, never less."""
    n = ids.count()
    marks = min(MOST_MARKS, max(FEWEST_MARKS, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(on), F.lit(marks)) + 1
    marked = ids.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    maps = marked.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    found = responses.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_bucket")
    return found.where(asked).select(*responses.columns)


def join_responses(mail: DataFrame, responses: DataFrame, on: str = "msg_id", unique: bool = False) -> DataFrame:
    """Adds ``body`` and ``error_code`` from a table of responses; null where there is none. Project
    ``mail`` to the columns still needed first: they go through the shuffle. Which side is broadcast,
    if any, is left to Spark's size threshold. ``unique`` promises that no message has two responses:
    then nothing is folded, and the bodies are shuffled and sorted once, by the join."""
    single = responses.select(on, "body", "error_code") if unique else single_responses(responses, on)
    return mail.join(single, on, "left")


def score_with(
    requests: DataFrame,
    make_scorer: ScorerFactory,
    keep: Sequence[str] = ("msg_id",),
    model_id: str | None = None,
    in_flight: int = 1,
) -> DataFrame:
    """The ``keep`` columns with ``body`` and ``error_code`` from the caller's scorer. ``make_scorer``
    gets the model id and runs once per task, so a client is opened once. Up to ``in_flight`` requests of a
    task wait for their answers at the same time, each in a thread of its own; a scorer must bear that if it is
    more than one. Whatever a scorer does concerns its mail only: failures, answers that are no text and odd
    error codes become that mail's error. Mail without a request is not scored."""
    keep = list(keep)
    picked = requests.select(*keep, "request")
    schema = T.StructType(
        [
            *(picked.schema[name] for name in keep),
            T.StructField("body", T.StringType()),
            T.StructField("error_code", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                score = score or make_scorer(model_id)
                requests = batch.column(len(keep)).to_pylist()
                answers = pool.map(functools.partial(_answer, score), requests)
                bodies, codes = zip(*answers, strict=True)
                arrays = [
                    *(batch.column(i) for i in range(len(keep))),
                    pa.array(bodies, pa.string()),
                    pa.array(codes, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "body", "error_code"])

    return picked.mapInArrow(run, schema)


def _answer(score: Scorer, request: str | None) -> tuple[str | None, str | None]:
    if request is None:
        return None, None
    try:
        body = score(request)
        return (_clean(body) if isinstance(body, str) else None), None
    except Exception as problem:  # without a code it counts like a missing response
        try:
            code = getattr(problem, "service_code", None)
            return None, None if code is None else _clean(str(code))
        except Exception:
            return None, None


def _clean(text: str) -> str:
    """Text that Arrow accepts: lone surrogates become U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def response_value(body: Column) -> Column:
    """``content[0].text`` of a response body as a variant; null when the body is not such JSON."""
    return F.try_variant_get(F.try_parse_json(body), "$.content[0].text", "variant")


def string_value(value: Column) -> Column:
    """The string in a variant; null for values of any other JSON type."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


_ANSWER_SCHEMA = "content ARRAY<STRUCT<text: STRING>>"


def response_texts(scored: DataFrame) -> DataFrame:
    """Adds ``text``, the model's answer, to rows with a response ``body``. A body that repeats a key is no
    variant; there the last value counts."""
    valued = scored.withColumn("_value", response_value(F.col("body")))
    last = F.get(F.from_json("body", _ANSWER_SCHEMA, {"allowSingleQuotes": "false"})["content"], F.lit(0))["text"]
    no_variant = F.col("body").isNotNull() & F.try_parse_json("body").isNull()
    text = F.when(no_variant, last).otherwise(string_value(F.col("_value")))
    return valued.withColumn("text", text).drop("_value")


def scoring_error(error_code: Column, text: Column) -> Column:
    """What the reply says instead of an analysis; null when there is an answer to analyse."""
    before, after = k.SERVICE_ERROR_TEXT.split("%s")
    refused = F.concat(F.lit(before), error_code, F.lit(after))
    return F.when(error_code.isNotNull(), refused).when(text.isNull(), F.lit(k.UNEXPECTED_ERROR_TEXT))
