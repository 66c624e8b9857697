"""Which message and which text of a parsed mail count. Native expressions over ``parts``, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtriage import constants as k
from mailtriage.functions.text import non_empty
from mailtriage.templates import fill

_ENVELOPE = "\nFrom: {sender}\nTo: {to}\nSubject: {subject}\n\n{body}\n"


_ROOTS = """
    transform(filter(parts, p -> p.is_root),
              p -> struct(p.message_no, p.n_headers, p.`from`, p.`to`, p.subject, p.root_error, p.is_multipart))
"""
# The body of a message that has no parts, and the texts that make up the body of one that has: its
# preferred body, or else all its plain parts. A message owns its own parts; the outer mail also owns
# those of forwards inside it as message/rfc822, but not those of attached .eml files.
_WHOLE = """
    CASE WHEN NOT chosen.is_multipart THEN
        get(filter(parts, p -> p.is_root AND p.message_no = chosen.message_no), 0).raw_text
    END
"""
_PREFERRED = """
    transform(filter(parts, p -> p.body_pref AND p.n_headers > 0 AND p.message_no = chosen.message_no),
              p -> struct(IF(p.same_text, p.raw_text, p.text) AS text, p.text_error))
"""
_PLAIN = """
    transform(filter(parts, p -> p.content_type = 'text/plain'
                     AND IF(chosen.message_no = 0, NOT p.in_eml, p.message_no = chosen.message_no)),
              p -> struct(IF(p.same_text, p.raw_text, p.text) AS text, p.text_error))
"""


def select_original(parsed: DataFrame) -> DataFrame:
    """Adds ``chosen``: the last embedded message in visit order, or the outer mail when there is none
    or when that last one has no headers. ``chosen.message_no`` is 0 for the outer mail."""
    last, outer = F.col("_roots")[F.size("_roots") - 1], F.col("_roots")[0]
    return (
        parsed.withColumn("_roots", F.expr(_ROOTS))
        .withColumns(
            {
                "chosen": F.when(last["n_headers"] > 0, last).otherwise(outer),
                "outer_from": outer["from"],
            }
        )
        .drop("_roots")
    )


def assemble_mail(parsed: DataFrame, catch_all: str, keep: Sequence[str] = ("msg_id",)) -> DataFrame:
    """``reply_to``, ``from``, ``to``, ``subject``, ``body``, ``envelope`` and ``error`` per mail.

    Headers and body all come from the chosen message, only the reply address from the outer one.
    All columns but ``error`` are null for a mail that cannot be processed."""
    chosen, used = F.col("chosen"), F.col("_used")
    preferred = F.when(chosen["is_multipart"], F.expr(_PREFERRED))
    decoded = (
        select_original(parsed)
        .withColumns({"_whole": F.expr(_WHOLE), "_preferred": preferred})
        .withColumn("_used", F.when(F.size("_preferred") == 0, F.expr(_PLAIN)).otherwise(F.col("_preferred")))
    )
    text_error = F.expr("get(filter(_used, u -> u.text_error IS NOT NULL), 0).text_error")
    body = F.coalesce(F.col("_whole"), F.array_join(used["text"], ""))
    error = F.coalesce("error", chosen["root_error"], text_error)
    # A generator of one row, not a projection: Spark would push a later filter on the error or the
    # reply address below a projection and evaluate the whole selection a second time for it.
    settled = F.struct("outer_from", "chosen", body.alias("body"), error.alias("error"))
    plain = decoded.select(*keep, F.inline(F.array(settled)))
    ok = F.col("error").isNull()
    sender = non_empty(chosen["from"], k.DEFAULT_ADDRESS)
    to = non_empty(chosen["to"], k.DEFAULT_ADDRESS)
    subject = non_empty(chosen["subject"], k.DEFAULT_SUBJECT)
    body = F.col("body")
    return plain.select(
        *keep,
        F.when(ok, non_empty(F.col("outer_from"), catch_all)).alias("reply_to"),
        F.when(ok, sender).alias("from"),
        F.when(ok, to).alias("to"),
        F.when(ok, subject).alias("subject"),
        F.when(ok, body).alias("body"),
        F.when(ok, fill(_ENVELOPE, sender=sender, to=to, subject=subject, body=body)).alias("envelope"),
        "error",
    )


def text_dump(parsed: DataFrame, keep: Sequence[str] = ("msg_id",), raw: bool = False) -> DataFrame:
    """What a reader of the stored mail sees, as ``dump``: the text parts decoded as UTF-8 in walk
    order, one per line, and embedded messages as source where ``parse_mail`` was asked for it (their
    text parts follow again). With ``raw`` the whole mail as source."""
    if raw:
        return parsed.select(*keep, F.col("source").alias("dump"), "error")
    first = F.col("parts")[0]

    def shown(part: Column) -> Column:
        is_text = F.startswith(part["content_type"], F.lit("text/"))
        return F.when(is_text, part["raw_text"]).otherwise(part["source"])

    walked = F.transform(F.filter("parts", lambda p: ~p["in_eml"]), shown)
    dump = F.when(first["is_multipart"], F.array_join(walked, "\n")).otherwise(first["raw_text"])
    return parsed.select(*keep, dump.alias("dump"), "error")
