"""Replies, tickets and outcomes of triaged mail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtriage import constants as k
from mailtriage.config import TriageConfig
from mailtriage.functions.text import html_to_text, non_empty
from mailtriage.templates import REPORT_TEMPLATE, REPORT_THEME, TICKET_TEMPLATE, fill


def reply_subject(is_phishing: Column, subject: Column) -> Column:
    return F.concat(F.when(is_phishing, k.REPLY_TAG_PHISHING).otherwise(k.REPLY_TAG_CLEAN), subject)


def report_html(is_phishing: Column, analysis: Column) -> Column:
    """The full HTML reply around an analysis, in the colours of the flag."""

    def themed(flag: bool) -> Column:
        text = REPORT_TEMPLATE
        for slot, value in REPORT_THEME[flag].items():
            text = text.replace("{" + slot + "}", value)
        return fill(text, analysis=analysis)

    return F.when(is_phishing, themed(True)).otherwise(themed(False))


def sender_address(sender: Column, domain: Column) -> Column:
    """The sender, else ``noreply@`` the domain, else the fixed default; empty counts as missing."""
    of_domain = F.when(domain != "", F.concat(F.lit("noreply@"), domain))
    return non_empty(sender, F.coalesce(of_domain, F.lit(k.DEFAULT_SENDER)))


def goes_to_catch_all(reply_to: Column, cfg: TriageConfig) -> Column:
    """True when the reply address is exactly the catch-all string."""
    return reply_to == F.lit(cfg.catch_all)


def build_outbox(
    triaged: DataFrame, cfg: TriageConfig, is_html: bool = True, keep: Sequence[str] = ("msg_id",)
) -> DataFrame:
    """One reply per processed mail, HTML with a text alternative, or text only."""
    replies = triaged.where(F.col("error").isNull()).withColumn(
        "_report", report_html(F.col("is_phishing"), F.col("analysis"))
    )
    report = F.col("_report")
    html = report if is_html else F.lit(None).cast("string")
    return replies.select(
        *keep,
        F.lit(cfg.reply_sender).alias("sender"),
        F.col("reply_to").alias("recipient"),
        F.col("reply_subject").alias("subject"),
        html.alias("body_html"),
        (html_to_text(report) if is_html else report).alias("body_text"),
        F.lit(cfg.config_set).alias("config_set"),
    )


def build_tickets(
    triaged: DataFrame, cfg: TriageConfig, run_ts: Column, keep: Sequence[str] = ("msg_id",)
) -> DataFrame:
    """One ticket per processed mail that was answered to the catch-all address. Needs ``ticket_text``,
    the redacted envelope. Empty unless token, owner and repository are all configured."""
    routed = triaged.where(F.col("error").isNull() & goes_to_catch_all(F.col("reply_to"), cfg))
    if not cfg.tickets_enabled:
        routed = routed.where(F.lit(False))
    flag = F.col("is_phishing")
    tag = F.when(flag, k.TICKET_TAG_PHISHING).otherwise(k.TICKET_TAG_CLEAN)
    body = fill(
        TICKET_TEMPLATE,
        verdict=F.when(flag, k.PHISHING).otherwise(k.CLEAN),
        time=F.date_format(run_ts, "yyyy-MM-dd HH:mm:ss"),
        mail=F.col("ticket_text"),
    )
    return routed.select(
        *keep,
        F.concat(tag, F.col("reply_subject")).alias("title"),
        body.alias("body"),
        F.array(*(F.lit(label) for label in k.TICKET_LABELS)).alias("labels"),
    )


def build_status(triaged: DataFrame, keep: Sequence[str] = ("msg_id",)) -> DataFrame:
    """The outcome of every mail: 200 or 500 with a JSON-encoded message."""
    failed = F.col("error").isNotNull()
    failure = F.concat(F.lit(k.STATUS_ERROR_PREFIX), F.col("error"))
    message = F.when(failed, failure).otherwise(F.lit(k.STATUS_OK_TEXT))
    return triaged.select(
        *keep,
        F.when(failed, 500).otherwise(200).alias("status"),
        _json_string(message).alias("status_body"),
        "error",
    )


def _json_string(text: Column) -> Column:
    # to_json takes no bare string: write it as the only element of an array, then drop the brackets.
    in_array = F.to_json(F.array(text))
    return F.substring(in_array, F.lit(2), F.length(in_array) - 2)
