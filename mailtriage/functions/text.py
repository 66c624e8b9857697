"""Text helpers usable on any string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailtriage.constants import REDACTIONS, TAG_REPLACEMENTS, WHITESPACE, WS

# First digit of a run with a word boundary before it, and the boundary after the last digit: no
# letter, number or underscore of any script next to the run. The digit is tested first, as most
# characters are none.
_FIRST_DIGIT = r"\p{Nd}(?<![\p{L}\p{N}_]\p{Nd})"
_END = r"(?![\p{L}\p{N}_])"
# The patterns of REDACTIONS in the same order. The address may only start at the left end of a run of
# address characters (or where the previous match ended), which keeps it linear on long unbroken runs.
_ADDRESS = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_PHONE = rf"{_FIRST_DIGIT}\p{{Nd}}{{2}}[-.{WS}]?\p{{Nd}}{{3}}[-.{WS}]?\p{{Nd}}{{4}}{_END}"
_URL = rf"https?://[^{WS}]+"
_CARD = rf"{_FIRST_DIGIT}\p{{Nd}}{{3}}[-{WS}]?(?:\p{{Nd}}{{4}}[-{WS}]?){{2}}\p{{Nd}}{{4}}{_END}"
_SSN = rf"{_FIRST_DIGIT}\p{{Nd}}{{2}}-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}{_END}"
_MASKS = dict(zip((_ADDRESS, _PHONE, _URL, _CARD, _SSN), (mask for _, mask in REDACTIONS), strict=True))
# Every number pattern needs three digits in a row.
_NUMBER = r"\p{Nd}{3}"


def strip(text: Column) -> Column:
    """Remove white space of every script from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def non_empty(text: Column, default: Column | str) -> Column:
    """``text``, or ``default`` when it is null or empty."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.when(text != "", text).otherwise(fallback)


def redact(text: Column) -> Column:
    """Mask mail addresses, phone numbers, URLs, card numbers and social security numbers.

    Cheap tests come first: masks never create an ``@``, a ``://`` or a digit, so texts without them
    need none of the patterns that look for them."""

    def masked(*patterns: str) -> Column:
        result = text
        for pattern in patterns:
            result = F.regexp_replace(result, pattern, _MASKS[pattern])
        return result

    names_one = F.contains(text, F.lit("@")) | F.contains(text, F.lit("://"))
    return (
        F.when(F.regexp_like(text, F.lit(_NUMBER)), masked(_ADDRESS, _PHONE, _URL, _CARD, _SSN))
        .when(names_one, masked(_ADDRESS, _URL))
        .otherwise(text)
    )


# An opener that is never closed matches up to the end of the text and is put back, so it is read once.
_STYLE_BLOCK = r"(?s)<style>.*?</style>|(<style>.*)\z"
_TAG = r"<[^>]*+>|(<[^>]*+)\z"


def html_to_text(html: Column) -> Column:
    """Readable text of an HTML document: no style blocks, no tags, blank runs closed up."""
    text = F.regexp_replace(html, _STYLE_BLOCK, "$1")
    for tag, replacement in TAG_REPLACEMENTS:
        text = F.replace(text, F.lit(tag), F.lit(replacement))
    text = F.regexp_replace(text, _TAG, "$1")
    text = F.regexp_replace(text, rf"\n[{WS}]*\n", "\n\n")
    return strip(F.regexp_replace(text, r" {2,}", " "))


def size_label(size: Column) -> Column:
    """Bytes as ``B``, ``KB``, ``MB`` or ``GB`` (base 1024, two decimals, half-even)."""
    size = size.cast("double")
    units = ("B", "KB", "MB", "GB")
    labels = [
        F.format_string(f"%.2f {unit}", F.bround(size / F.lit(1024.0**power), 2))
        for power, unit in enumerate(units)
    ]
    return (
        F.when(size < 1024, labels[0])
        .when(size < 1024**2, labels[1])
        .when(size < 1024**3, labels[2])
        .otherwise(labels[3])
    )


def preview(text: Column, limit: int | None = None) -> Column:
    """First ``limit`` characters and a note on how many follow; the whole text without a limit."""
    if not limit:
        return text
    rest = (F.length(text) - F.lit(limit)).cast("string")
    cut = F.concat(F.left(text, F.lit(limit)), F.lit("\n\n[... "), rest, F.lit(" more characters ...]"))
    return F.when(F.length(text) > limit, cut).otherwise(text)
