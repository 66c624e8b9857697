from __future__ import annotations

import random
import re

import pytest

from mailtriage.functions import verdict as v
from mailtriage.operators.verdicts import judge, section_items

RED = "[SECTION]RED FLAGS[/SECTION]"
TIPS = "[SECTION]HOW TO IDENTIFY SIMILAR THREATS[/SECTION]"
GOOD = "[SECTION]CLEAN INDICATORS[/SECTION]"


def plain_flag(text):
    """The rule in its reduced form: a mention early on, or a red-flags section and no bare verdict."""
    lines = text.strip().upper().split("\n")
    bare = {line.strip() for line in lines[:5]} & {"PHISHING", "CLEAN"}
    return "PHISHING" in "\n".join(lines[:20]) or (not bare and RED in text)


def plain_sections(text):
    lines = text.strip().split("\n")
    headers = [(at, m[1]) for at, line in enumerate(lines) if (m := re.search(r"\[SECTION\](.*?)\[/SECTION\]", line))]
    ends = [at for at, _ in headers[1:]] + [len(lines)]
    bodies = {name: lines[at + 1 : end] for (at, name), end in zip(headers, ends, strict=False)}
    found = {name: [plain_item(x) for x in body if is_item(x)] for name, body in bodies.items()}
    return {name: items for name, items in found.items() if name and items}


def is_item(line):
    return line.strip() and not re.search("PHISHING|CLEAN", line)


def plain_item(line):
    bare = re.sub(r"^[•*-]\s*", "", line.strip())
    return re.sub(r"\*\*(.*?)\*\*", r"<strong>\1</strong>", bare)


def plain_label(text):
    word = re.search("PHISHING|CLEAN", text)
    return word[0] if word else ""


def plain_html(text):
    label, flag, found = plain_label(text), plain_flag(text), plain_sections(text)
    out = [f"<div class='verdict'><h3>{label}</h3></div>" if label else ""]
    names = ("RED FLAGS", "HOW TO IDENTIFY SIMILAR THREATS") if flag else ("CLEAN INDICATORS",)
    for name in names:
        if name in found:
            items = [f"<li>{i}</li>" for i in found[name]]
            out += [f"<h3 class='{'red' if flag else 'green'}-section'>{name}</h3>", "<ul>", *items, "</ul>"]
    return "\n".join(out)


CASES = [
    # text, flag, label, html items
    (f"PHISHING\n\n{RED}\n- **Urgent** T\n• second\n{TIPS}\n* tip", True, "PHISHING", ["<strong>Urgent</strong> T", "second", "tip"]),
    (f"CLEAN\n\n{GOOD}\n- T", False, "CLEAN", ["T"]),
    (f"CLEAN\n{GOOD}\n- No phishing signs\n- ok", True, "CLEAN", []),
    (f"**CLEAN**\n{GOOD}\n- T", False, "CLEAN", ["T"]),
    (f"Verdict: suspicious\n{RED}\n- T", True, "", ["T"]),
    (f"CLEAN\n{RED}\n- T", False, "CLEAN", []),
    ("filler\n" * 20 + "PHISHING", False, "PHISHING", []),
    (f"PHISHING\n{RED}\n- a\n{RED}\n- b", True, "PHISHING", ["b"]),
    (f"PHISHING\n{RED}\n- This is PHISHING mail\n**Lead** x\n- kept", True, "PHISHING", ["*Lead** x", "kept"]),
    ("CLEAN\r\nx\r", False, "CLEAN", []),
    (f"\xa0CLEAN\x0b\n{RED}\n- x", False, "CLEAN", []),
    (f"phishing\n{RED}\n- x", True, "", ["x"]),
    ("", False, "", []),
    (f"PHISHING\n{RED} lost text\n- a\n[SECTION][/SECTION]\n- b\n[SECTION]OTHER[/SECTION]\n- c", True, "PHISHING", ["a"]),
    (f"PHISHING\n{RED}\n- a **b\u2028c** \r\n-- x", True, "PHISHING", ["a <strong>b\u2028c</strong>", "- x"]),
]


@pytest.mark.parametrize(("text", "flag", "label", "items"), CASES)
def test_golden(spark, text, flag, label, items):
    row = judge(spark.createDataFrame([(1, text)], "msg_id int, text string")).first()
    assert (row.is_phishing, row.label) == (flag, label)
    assert re.findall("(?s)<li>(.*?)</li>", row.analysis) == items
    assert row.analysis == plain_html(text)


def soup(rng):
    lines = [
        "PHISHING", "CLEAN", "**CLEAN**", "phishing", " clean ", "\xa0PHISHING\x0b", "Verdict: PHISHING", RED, TIPS, GOOD,
        "[SECTION]OTHER[/SECTION]", "[SECTION][/SECTION]", "[SECTION]no end", "x [SECTION]RED FLAGS[/SECTION] y [SECTION]z[/SECTION]",
        "- a", "• **b** c", "* *d*", "**e** **f", "", "   ", "\t- g\r", "text", "- CLEAN item", "-", "\u2003- h\u2028i",
        "ſ phıshıng", "fill", "fill",
    ]
    return "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 30)))


def test_random_answers(spark):
    rng = random.Random(3)
    texts = [soup(rng) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "msg_id int, text string").repartition(4)
    for row in judge(rows).collect():
        text = texts[row.msg_id]
        assert row.is_phishing == plain_flag(text), text
        assert row.label == plain_label(text), text
        assert row.analysis == plain_html(text), text
    items = {}
    for row in section_items(rows).orderBy("msg_id", "section", "pos").collect():
        section = items.setdefault(row.msg_id, {}).setdefault(row.section, [])
        section.append(row.item)
        assert row.pos == len(section)
    assert items == {i: found for i, x in enumerate(texts) if (found := plain_sections(x))}


def test_item_html(column):
    assert column(v.item_html, ["• a", "**x** y", "-", "- - b", "a **b** c **d"]) == [
        "a", "*x** y", "", "- b", "a <strong>b</strong> c **d",
    ]
