"""The header block of a mail read by native expressions, where it is plain enough to need no parser.

Plain: ASCII lines ended by a line feed, with or without a carriage return, each a named header or the continuation
of one; every ``From``, ``To``, ``Subject`` on one line with a value that structured parsing would give back as it is;
the block ends within ``HEAD_BYTES``. About any other mail nothing is said here, and the parser of ``mime`` reads it.

Repeated groups in the patterns are possessive: matching them neither backtracks nor uses the stack, however long a
header is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 1 << 16
_FOLD = "\x01"  # stands for the line end before a continuation
_ADDRESS = r"[A-Za-z0-9_+-]++(?:\.[A-Za-z0-9_+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
_MAILBOX = rf"(?:{_ADDRESS}|[A-Za-z]++(?: [A-Za-z]++)*+ <{_ADDRESS}>)"
_SUBJECT = r"[!-<>-~]++(?: [!-<>-~]++)*+"
_PLAIN = (
    rf"(?i)\A(?:(?:from|to):[ \t]*+{_MAILBOX}"
    rf"|subject:[ \t]*+{_SUBJECT}"
    rf"|(?!(?:from|to|subject):)[!-9;-~]++:[\x20-\x7E\t{_FOLD}]*+)\z"
)
# A body that is one text in a charset without surprises: no parts, no file name.
_ONE_TEXT = r"""(?i)\Acontent-type:[ \t]*+text/(?:plain|html)(?:; ?charset=(?:utf-8|us-ascii|"utf-8"|"us-ascii"))?\z"""
_SHAPE = r"(?i)\Acontent-(?:type|disposition):"


def header_scan(content: Column) -> Column:
    """A struct of ``to_addrs`` (lower case), ``from``, ``to``, ``subject``, ``n_headers`` and ``content_type``, the
    last only where the mail is known to be one undivided text; null for a mail whose headers are not plain."""
    head = F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1")
    return _let(
        _let(F.split(head, r"\r?\n\r?\n", 2), lambda cut: F.when(F.size(cut) == 2, _unfolded(cut[0]))),
        lambda lines: F.when(F.forall(lines, lambda line: line.rlike(_PLAIN)), _columns(lines)),
    )


def _unfolded(block: Column) -> Column:
    return F.split(F.regexp_replace(block, r"\r?\n(?=[ \t])", _FOLD), r"\r?\n", -1)


def _columns(lines: Column) -> Column:
    mailboxes = F.filter(lines, lambda line: line.rlike(r"(?i)\Ato:"))
    shapes = F.filter(lines, lambda line: line.rlike(_SHAPE))
    kind = (
        F.when(F.size(shapes) == 0, F.lit("text/plain"))
        .when(
            (F.size(shapes) == 1) & F.get(shapes, F.lit(0)).rlike(_ONE_TEXT),
            F.lower(F.regexp_extract(F.get(shapes, F.lit(0)), r"(?i)text/(?:plain|html)", 0)),
        )
    )
    return F.struct(
        F.transform(mailboxes, lambda line: F.lower(F.regexp_replace(line, r"\A.*[:<\x20\t]|>\z", ""))).alias("to_addrs"),
        *(_first(lines, name).alias(name) for name in ("from", "to", "subject")),
        F.size(lines).alias("n_headers"),
        kind.alias("content_type"),
    )


def _first(lines: Column, name: str) -> Column:
    own = F.filter(lines, lambda line: line.rlike(rf"(?i)\A{name}:"))
    return F.regexp_replace(F.get(own, F.lit(0)), r"\A[^:]*+:[ \t]*+", "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
