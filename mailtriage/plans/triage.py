"""The triage job: raw mail in, one decided row per mail out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtriage.config import TriageConfig
from mailtriage.functions.text import redact
from mailtriage.operators.mime import parse_mail
from mailtriage.operators.objects import requested_objects
from mailtriage.operators.report import goes_to_catch_all, reply_subject
from mailtriage.operators.scoring import (
    ScorerFactory,
    build_prompts,
    build_requests,
    join_responses,
    score_with,
)
from mailtriage.operators.selection import assemble_mail
from mailtriage.operators.verdicts import judge_responses
from mailtriage.sources.mail import read_objects, spread
from mailtriage.sources.notifications import parse_notifications


def read_mail(
    mail: DataFrame, cfg: TriageConfig, id_col: str = "msg_id", with_texts: bool = True
) -> DataFrame:
    """Raw mail (``content``) after the intake filter, assembled: see ``assemble_mail``. Without ``with_texts`` only
    headers count, and ``body`` and ``envelope`` are left empty."""
    parsed = parse_mail(mail, keep=(id_col,), recipients=cfg.recipients, with_texts=with_texts)
    return assemble_mail(parsed, cfg.catch_all, keep=(id_col,))


def land_mail(mail: DataFrame, cfg: TriageConfig, path: str, id_col: str = "msg_id") -> DataFrame:
    """Assembled mail, written once as Parquet and read back. For jobs that need it more than once, such
    as requests now and decisions after scoring elsewhere: mail is then parsed a single time, and many
    small objects become few large files."""
    assembled = read_mail(mail, cfg, id_col)
    assembled.write.mode("overwrite").parquet(path)
    return mail.sparkSession.read.schema(assembled.schema).parquet(path)


def requests_for(
    assembled: DataFrame, cfg: TriageConfig, run_date: Column | None = None, id_col: str = "msg_id"
) -> DataFrame:
    """``request`` and ``model_id`` per mail that can be processed, for scoring it elsewhere."""
    prompts = build_prompts(assembled, F.current_date() if run_date is None else run_date, cfg)
    return build_requests(prompts, cfg).where(F.col("request").isNotNull()).select(
        id_col, "request", F.lit(cfg.model_id).cast("string").alias("model_id")
    )


def light_mail(assembled: DataFrame, cfg: TriageConfig, id_col: str = "msg_id") -> DataFrame:
    """What a decision needs of a mail beside its answer: the reply address, the subject, the error and, only where
    a ticket is due, the redacted text."""
    due = goes_to_catch_all(F.col("reply_to"), cfg) & F.lit(cfg.tickets_enabled)
    mail = assembled.withColumn("ticket_text", F.when(due, redact(F.col("envelope"))))
    return mail.select(id_col, "reply_to", "subject", "ticket_text", "error")


def decide(
    assembled: DataFrame,
    cfg: TriageConfig,
    responses: DataFrame | None = None,
    make_scorer: ScorerFactory | None = None,
    run_date: Column | None = None,
    id_col: str = "msg_id",
    unique: bool = False,
) -> DataFrame:
    """One row per assembled mail: ``reply_to``, ``reply_subject``, ``is_phishing``, ``label``,
    ``analysis``, ``score_error``, ``ticket_text`` and ``error``.

    Answers come from a ``responses`` table (``msg_id, body, error_code``) or from the caller's scorer.
    The table is joined after each mail has shrunk to what :func:`light_mail` keeps: bodies of other mails
    are not shuffled. ``unique`` promises at most one response per mail, as in a table that ``score_with``
    wrote. With a scorer nothing is shuffled at all."""
    if (responses is None) == (make_scorer is None):
        raise ValueError("give either a responses table or a scorer")
    light = light_mail(assembled, cfg, id_col)
    if make_scorer is None:
        return decide_light(light, cfg, responses, id_col, unique)
    due = goes_to_catch_all(F.col("reply_to"), cfg) & F.lit(cfg.tickets_enabled)
    mail = assembled.withColumn("ticket_text", F.when(due, redact(F.col("envelope"))))
    prompts = build_prompts(mail, F.current_date() if run_date is None else run_date, cfg)
    requests = build_requests(prompts, cfg)
    return _decided(score_with(requests, make_scorer, light.columns, cfg.model_id, cfg.in_flight), id_col)


def decide_light(
    light: DataFrame, cfg: TriageConfig, responses: DataFrame, id_col: str = "msg_id", unique: bool = False
) -> DataFrame:
    """Decisions for rows of :func:`light_mail`."""
    kept = light.select(id_col, "reply_to", "subject", "ticket_text", "error")
    return _decided(join_responses(kept, responses, id_col, unique), id_col)


def _decided(scored: DataFrame, id_col: str) -> DataFrame:
    judged = judge_responses(scored)
    ok = F.col("error").isNull()
    return judged.select(
        id_col,
        "reply_to",
        reply_subject(F.col("is_phishing"), F.col("subject")).alias("reply_subject"),
        *(F.when(ok, F.col(c)).alias(c) for c in ("is_phishing", "label", "analysis", "score_error")),
        "ticket_text",
        "error",
    )


def triage(
    mail: DataFrame,
    cfg: TriageConfig,
    responses: DataFrame | None = None,
    make_scorer: ScorerFactory | None = None,
    run_date: Column | None = None,
    id_col: str = "msg_id",
    unique: bool = False,
) -> DataFrame:
    """From raw mail to decided rows in one plan: see :func:`decide`."""
    return decide(read_mail(mail, cfg, id_col), cfg, responses, make_scorer, run_date, id_col, unique)


def replay(
    listing: DataFrame,
    requested: DataFrame,
    cfg: TriageConfig,
    responses: DataFrame | None = None,
    make_scorer: ScorerFactory | None = None,
    run_date: Column | None = None,
    id_col: str = "msg_id",
    read: Callable[[DataFrame], DataFrame] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Triage of the stored mail that is asked for. The requests meet the ``listing`` (``id_col, path``), which
    holds no content; only what is left is opened, by ``read`` or else by :func:`read_objects`. ``read`` gets the
    picked rows of the listing and adds ``content``. Missing objects: see ``missing_objects``. The picked rows are dealt over
    ``tasks``, or as :func:`spread` says: adaptive execution would go by their bytes, and a path is small."""
    if "content" in listing.columns:
        raise ValueError("replay needs a listing without contents")
    picked = requested_objects(listing, requested, on=id_col)
    found = read(picked) if read else read_objects(picked, keep=(id_col,), tasks=tasks or spread(picked.sparkSession))
    return triage(found, cfg, responses, make_scorer, run_date, id_col)


def triage_notifications(
    events: DataFrame,
    cfg: TriageConfig,
    locate: Callable[[Column, Column], Column],
    responses: DataFrame | None = None,
    make_scorer: ScorerFactory | None = None,
    run_date: Column | None = None,
    id_col: str = "msg_id",
    event_col: str = "event",
    tasks: int | None = None,
) -> DataFrame:
    """One decided row for each notification: see :func:`read_notified`."""
    assembled = read_notified(events, cfg, locate, id_col, event_col, tasks)
    return decide(assembled, cfg, responses, make_scorer, run_date, id_col)


def read_notified(
    events: DataFrame,
    cfg: TriageConfig,
    locate: Callable[[Column, Column], Column],
    id_col: str = "msg_id",
    event_col: str = "event",
    tasks: int | None = None,
) -> DataFrame:
    """The mail that notifications tell of, assembled, a row for each. ``locate`` makes the path of an object from its
    bucket and key. An event that cannot be read, or whose object cannot, has the reason as its ``error``, which
    ``build_status`` turns into a 500. Objects are opened by path, in tasks; nothing is listed."""
    located = parse_notifications(events.select(id_col, event_col), event_col)
    readable = F.col("error").isNull()
    asked = located.select(
        id_col,
        F.when(readable, locate(F.col("bucket"), F.col("key"))).alias("path"),
        F.col("error").alias("event_error"),
    )
    found = read_objects(asked, keep=(id_col, "event_error"), tasks=tasks)
    return _read_found(found.withColumn("problem", F.coalesce("event_error", "read_error")), cfg, id_col)


def _read_found(found: DataFrame, cfg: TriageConfig, id_col: str) -> DataFrame:
    """Opened objects (``content``), assembled; a ``problem`` with opening one is its error."""
    parsed = parse_mail(found, keep=(id_col, "problem"), recipients=cfg.recipients)
    parsed = parsed.withColumn("error", F.coalesce("problem", "error"))
    return assemble_mail(parsed, cfg.catch_all, keep=(id_col,))


def replay_outcomes(
    listing: DataFrame,
    requested: DataFrame,
    cfg: TriageConfig,
    responses: DataFrame | None = None,
    make_scorer: ScorerFactory | None = None,
    run_date: Column | None = None,
    id_col: str = "msg_id",
    tasks: int | None = None,
) -> DataFrame:
    """As :func:`replay`, with a row for each object that is asked for, stored or not: one that the ``listing`` (``id_col,
    path``) does not hold is never opened and has that as its error. Repeated requests are one. ``tasks`` as there."""
    if "content" in listing.columns:
        raise ValueError("replay needs a listing without contents")
    asked = requested.select(id_col, F.xxhash64(id_col).alias("_hash")).distinct().select(id_col)
    located = asked.join(listing.select(id_col, "path"), id_col, "left")
    missing = F.when(F.col("path").isNull(), F.concat(F.lit("no such object: "), F.col(id_col).cast("string")))
    tasks = tasks or spread(located.sparkSession)
    found = read_objects(located.withColumn("absent", missing), keep=(id_col, "absent"), tasks=tasks)
    assembled = _read_found(found.withColumn("problem", F.coalesce("absent", "read_error")), cfg, id_col)
    return decide(assembled, cfg, responses, make_scorer, run_date, id_col)
