from __future__ import annotations

import random
import re
import sys
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from mailtriage import constants as k
from mailtriage.functions import text as t

NBSP = "\xa0"


def plain_redact(text):
    for pattern, mask in k.REDACTIONS:
        text = re.sub(pattern, mask, text)
    return text


def plain_html_to_text(html):
    text = re.sub("(?s)<style>.*?</style>", "", html)
    for tag, replacement in k.TAG_REPLACEMENTS:
        text = text.replace(tag, replacement)
    blank = re.compile(r"\n\s*\n")
    return re.sub(" +", " ", blank.sub("\n\n", re.sub("<[^>]*>", "", text))).strip()


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("call 555.123.4567, see http://x.y/z?e=a@b.co.", "call [PHONE], see [URL]"),
        ("4111 1111 1111 1111", "[CREDIT_CARD]"),
        ("1234-5678-9012-3456-", "[CREDIT_CARD]-"),
        ("123-45-6789", "[SSN]"),
        ("a@b.c", "a@b.c"),
        ("http://u@h.com/4111111111111111", "[URL]"),
        ("x_5551234567", "x_5551234567"),
        ("é5551234567", "é5551234567"),
        (f"555{NBSP}123{NBSP}4567", "[PHONE]"),
        ("555\x1c123\x1c4567", "[PHONE]"),
        ("a@b.com_x@y.org", "[EMAIL][EMAIL]"),
        ("a@b.comc@d.org", "[EMAIL]@d.org"),
    ],
)
def test_redact(column, given, expected):
    assert plain_redact(given) == expected
    assert column(t.redact, [given]) == [expected]


def test_redact_treats_every_character_as_python_does(column):
    chars = [chr(c) for c in range(1, sys.maxunicode) if not 0xD800 <= c <= 0xDFFF]
    # One line per 200 characters keeps this to a few thousand rows; every 7th astral character is enough.
    chars = [c for c in chars if ord(c) < 0x10000 or ord(c) % 7 == 0]
    texts = []
    for i in range(0, len(chars), 200):
        group = chars[i : i + 200]
        texts.append("|".join(f"{c}555{c}123{c}4567{c}" for c in group))
        texts.append("|".join(f"http://{c}x 123-45-678{c} {c}123-45-6789 a{c}b@c.de" for c in group))


    expected = [plain_redact(x) for x in texts]
    wrong = [
        (x, e, g) for x, e, g in zip(texts, expected, column(t.redact, texts), strict=True) if e != g
    ]

    def newer(text):  # characters that only one of the two Unicode versions knows
        return [c for c in text if ord(c) > 127 and unicodedata.category(c)[0] in "LN"]

    assert not [w for w in wrong if not newer(w[0])]
    assert len(wrong) < 150  # all of them because of characters added after Java 17's Unicode 13


def test_redact_random_soup(column):
    rng = random.Random(5)
    atoms = ["555", "1234", "12", "-", ".", " ", "@", "a", "b.co", "http://", "https://x", "_", "é", "\n", "6789"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    assert column(t.redact, texts) == [plain_redact(x) for x in texts]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("<style>x</style><h1>A</h1><p>b  c</p><ul><li>d</li></ul>", "A\n\nb c\nd"),
        ('<p class="k">a</p><BR>b&amp;c', "a\nb&amp;c"),
        ("a<br>b<hr>c", "a\nb" + "-" * 40 + "c"),
        ("<style>never closed <b>x</b>", "never closed x"),
        ("a < b", "a < b"),
        ("</h<h1>1>x", "x"),
        ("", ""),
    ],
)
def test_html_to_text(column, given, expected):
    assert plain_html_to_text(given) == expected
    assert column(t.html_to_text, [given]) == [expected]


def test_html_to_text_random_soup(column):
    rng = random.Random(6)
    atoms = ["<style>", "</style>", "<p>", "</p>", "<h1>", "</h1>", "<", ">", "x", " ", "\n", "\t", NBSP]
    atoms += ["<br>", "</div>", "<b a=1>", "\x1c", "\u2028", "<strong>", "</strong>", "\r"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    assert column(t.html_to_text, texts) == [plain_html_to_text(x) for x in texts]


def test_long_unbroken_runs_take_linear_time(column):
    n = 300_000
    hostile = ["a" * n, "a." * n, "a@" * n, "1" * n, "<" * n, "<style>" * (n // 7), "\n" + " " * n + "x", " " * n]
    hostile += ["<style>x</style>" * (n // 16) + "<style>" * (n // 7), "<p>" * (n // 3) + "<" * n, "</style>" + "<style>" * n]
    start = time.time()
    redacted = column(t.redact, hostile)
    column(t.html_to_text, hostile)
    assert time.time() - start < 30
    assert redacted[0] == hostile[0]


def test_strip_removes_what_python_removes(column):
    spaces = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
    texts = [f"{spaces}a{c}b{spaces}" for c in spaces] + [spaces, "", "x"] + [f"{c}x{c}" for c in "\u200b\ufeff\0"]
    assert column(t.strip, texts) == [x.strip() for x in texts]


def test_size_label(spark):
    sizes = [0, 1023, 1024, 1152, 1536, 2**40, 1048575, 2**20, 2**30 - 1, 2**30] + list(range(1000, 9000, 7))

    def plain(size):
        for power, unit in enumerate(("B", "KB", "MB")):
            if size < 1024 ** (power + 1):
                return f"{size / 1024**power:.2f} {unit}"
        return f"{size / 1024**3:.2f} GB"

    assert [plain(x) for x in sizes[:6]] == ["0.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1.50 KB", "1024.00 GB"]
    rows = spark.createDataFrame([(x,) for x in sizes], "size long")
    got = {r.size_: r.label for r in rows.select(F.col("size").alias("size_"), t.size_label(F.col("size")).alias("label")).collect()}
    assert got == {x: plain(x) for x in sizes}


@pytest.mark.parametrize(
    ("limit", "expected"),
    [(3, "abc\n\n[... 3 more characters ...]"), (10, "abcdef"), (6, "abcdef"), (None, "abcdef"), (0, "abcdef")],
)
def test_preview(column, limit, expected):
    assert column(lambda c: t.preview(c, limit), ["abcdef"]) == [expected]


def test_non_empty(column):
    assert column(lambda c: t.non_empty(c, "d"), ["x", "", None, " "]) == ["x", "d", "d", " "]
