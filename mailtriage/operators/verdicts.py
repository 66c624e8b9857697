"""Verdicts, sections and analysis HTML of model answers. Row by row in the JVM: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailtriage.functions import verdict as v
from mailtriage.operators.scoring import response_texts, scoring_error


def with_sections(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``sections``: ``ARRAY<STRUCT<name, items>>``."""
    return (
        answers.withColumn("_lines", v.answer_lines(F.col(text_col)))
        .withColumn("_headers", v.section_headers(F.col("_lines")))
        .withColumn("sections", v.sections(F.col("_lines"), F.col("_headers")))
        .drop("_lines", "_headers")
    )


def section_items(answers: DataFrame, text_col: str = "text", keep: Sequence[str] = ("msg_id",)) -> DataFrame:
    """One row per item: ``section``, ``pos`` (from 1, within its section) and ``item``."""
    found = with_sections(answers, text_col).select(*keep, F.explode("sections").alias("s"))
    return found.select(
        *keep, F.col("s.name").alias("section"), F.posexplode("s.items").alias("pos", "item")
    ).withColumn("pos", F.col("pos") + 1)


def judge(scored: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``is_phishing``, ``label`` and ``analysis`` (HTML) for an answer text."""
    text = F.col(text_col)
    judged = with_sections(
        scored.withColumns({"is_phishing": v.phishing_flag(text), "label": v.verdict_label(text)}), text_col
    )
    html = v.analysis_html(F.col("label"), F.col("is_phishing"), F.col("sections"))
    return judged.withColumn("analysis", html).drop("sections")


def judge_responses(scored: DataFrame) -> DataFrame:
    """From ``body`` and ``error_code`` to ``is_phishing``, ``label``, ``analysis`` and ``score_error``.
    A message without a usable answer counts as not phishing and says so in its analysis."""
    error = scoring_error(F.col("error_code"), F.col("text"))
    answers = response_texts(scored).withColumn("score_error", error)
    answers = answers.withColumn("text", F.when(F.col("score_error").isNull(), F.col("text")))
    return (
        judge(answers)
        .withColumns(
            {
                "is_phishing": F.coalesce("is_phishing", F.lit(False)),
                "label": F.coalesce("label", F.lit("")),
                "analysis": F.coalesce("score_error", "analysis"),
            }
        )
        .drop("body", "error_code", "text")
    )
