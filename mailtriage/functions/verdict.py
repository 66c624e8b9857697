"""Verdict rules on a model's answer text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailtriage import constants as k
from mailtriage.functions.text import strip

# A line that is nothing but the verdict word.
_VERDICT_LINE = rf"(?:\A|\n)[{k.WS_IN_LINE}]*(?:{k.PHISHING}|{k.CLEAN})[{k.WS_IN_LINE}]*(?:\z|\n)"
# The atomic group pins the first opener, so a line is read once even if it is never closed.
_HEADER = r"(?s)\A(?>.*?\[SECTION\])(.*?)\[/SECTION\]"


def phishing_flag(answer: Column) -> Column:
    """True when the first 20 lines mention phishing, or when no line of the first five is a bare
    verdict and the answer has a red-flags section. Independent of :func:`verdict_label`."""
    text = strip(answer)
    first_20 = F.upper(F.substring_index(text, "\n", 20))
    first_5 = F.upper(F.substring_index(text, "\n", 5))
    marker = k.SECTION_OPEN + k.RED_FLAGS + k.SECTION_CLOSE
    return F.contains(first_20, F.lit(k.PHISHING)) | (
        ~F.regexp_like(first_5, F.lit(_VERDICT_LINE)) & F.contains(answer, F.lit(marker))
    )


def verdict_label(answer: Column) -> Column:
    """The leftmost verdict word (case-sensitive), or an empty string."""
    return F.regexp_extract(answer, f"({k.PHISHING}|{k.CLEAN})", 1)


def answer_lines(answer: Column) -> Column:
    """The lines of an answer, each stripped; no rule looks at white space around a line."""
    return F.transform(F.split(strip(answer), "\n", -1), strip)


def section_headers(lines: Column) -> Column:
    """``ARRAY<STRUCT<at, name>>``: the zero-based positions and names of the section header lines."""

    def header(line: Column, at: Column) -> Column:
        name = F.when(
            F.contains(line, F.lit(k.SECTION_OPEN)) & F.regexp_like(line, F.lit(_HEADER)),
            F.regexp_extract(line, _HEADER, 1),
        )
        return F.struct(at.alias("at"), name.alias("name"))

    return F.filter(F.transform(lines, header), lambda h: h["name"].isNotNull())


def bold(line: Column) -> Column:
    marked = F.regexp_replace(line, r"(?s)\*\*(.*?)\*\*", "$1".join(k.BOLD_MARKS))
    return F.when(F.contains(line, F.lit("**")), marked).otherwise(line)


def without_bullet(line: Column) -> Column:
    """A stripped line without one leading bullet and the white space after it."""
    rest = F.ltrim(F.substring(line, F.lit(2), F.length(line)), F.lit(k.WHITESPACE))
    return F.when(F.left(line, F.lit(1)).isin(*k.BULLETS), rest).otherwise(line)


def item_html(line: Column) -> Column:
    """One stripped answer line as item text: one leading bullet removed, ``**x**`` made bold."""
    return bold(without_bullet(line))


def sections(lines: Column, headers: Column) -> Column:
    """``ARRAY<STRUCT<name, items>>``. A section runs from the last header of its name to the next
    header of any name; blank lines and lines that hold a verdict word are not items."""

    def is_item(line: Column) -> Column:
        return (line != "") & ~F.contains(line, F.lit(k.PHISHING)) & ~F.contains(line, F.lit(k.CLEAN))

    def section(header: Column, nth: Column) -> Column:
        following = F.get(headers, nth + 1)["at"]
        length = F.coalesce(following, F.size(lines)) - header["at"] - 1
        body = F.slice(lines, header["at"] + 2, length)
        later = F.slice(headers, nth + 2, F.size(headers))
        repeated = F.exists(later, lambda h: h["name"] == header["name"])
        return F.struct(
            header["name"].alias("name"),
            F.transform(F.transform(F.filter(body, is_item), without_bullet), bold).alias("items"),
            repeated.alias("repeated"),
        )

    found = F.filter(F.transform(headers, section), lambda s: ~s["repeated"] & (s["name"] != ""))
    return F.transform(found, lambda s: F.struct(s["name"].alias("name"), s["items"].alias("items")))


def analysis_html(label: Column, is_phishing: Column, found: Column) -> Column:
    """Verdict box, then the sections that go with the flag, in fixed order, when they have items."""

    def block(name: str, style: str) -> Column:
        items = F.get(F.filter(found, lambda s: s["name"] == name), F.lit(0))["items"]
        rows = F.transform(items, lambda i: _between(k.ITEM_MARKS, i))
        title = k.SECTION_TITLE.format(style=style, name=name)
        lines = F.concat(F.array(F.lit(title), F.lit(k.LIST_MARKS[0])), rows, F.array(F.lit(k.LIST_MARKS[1])))
        return F.when(F.size(items) > 0, F.array_join(lines, "\n"))

    verdict = F.when(label != "", _between(k.VERDICT_BOX, label)).otherwise("")
    phishing = F.concat_ws(
        "\n", verdict, block(k.RED_FLAGS, k.PHISHING_STYLE), block(k.SIMILAR_THREATS, k.PHISHING_STYLE)
    )
    clean = F.concat_ws("\n", verdict, block(k.CLEAN_INDICATORS, k.CLEAN_STYLE))
    return F.when(is_phishing, phishing).otherwise(clean)


def _between(marks: tuple[str, str], text: Column) -> Column:
    return F.concat(F.lit(marks[0]), text, F.lit(marks[1]))
