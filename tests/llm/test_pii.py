from __future__ import annotations

import random
import re

import numpy as np
import pytest

from mailtriage.llm import pii
from mailtriage.llm.queries import op10_pii


def plain(text):
    text, found = text or "", []
    found += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


PIECES = ["a", "b.c", "@", "x-y", ".", "com", "_", "%", " ", "1", "22", "255", "256", "4111111111111111", "4111 1111 1111 1111", "-", "+", "(", ")", "é", "😀", "0", "\n", "10.0.0.1", "+1 (017) 555-7713"]


def test_against_plain_search():
    random.seed(11)
    for _ in range(30_000):
        text = "".join(random.choices(PIECES, k=random.randint(1, 12)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 200_000, "a." * 100_000 + "@", "1" * 200_000, "1." * 100_000, "@" * 100_000, "a@b" * 50_000, "+1" * 100_000, "0" * 6000 + ".1.1.1"])
def test_time_is_linear(text):
    pii.base_spans(text)
    pii.proposals(text)


def test_query(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = op10_pii(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in pii.BASE_KINDS]
        assert r.base_sha256 == pii.digest(want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_trees_find_more_of_the_same_form(spark):
    random.seed(2)
    rows = []
    for i in range(3000):
        words = [random.choice(["the", "order", "of", "item", "page", "year"]) for _ in range(8)]
        if i % 2:
            words.insert(4, f"call +1 ({random.randint(100, 999)}) 555-{random.randint(1000, 9999)}")
        else:
            words.insert(4, f"number {random.randint(10**7, 10**9)}")
        rows.append((i, " ".join(words)))
    rows.append((5000, "please call (212) 555-0182 today"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trees, thresholds = pii.train(pii.texts(docs))
    assert trees is not None
    number = [x[0] for x in pii.GENERATORS].index("number")
    assert 0 < thresholds[number] <= 1
    text = rows[2][1]
    (n, a, b), *_ = pii.proposals(text)
    assert n == number and trees.score(np.array([pii.features(text, n, a, b)]))[0] < thresholds[number]


def test_awkward_rows(awkward, no_rows):
    found = pii.find_personal_data(awkward).collect()
    assert len(found) == awkward.count()
    assert sorted((x.kind, x.start, x.end) for r in found for x in r.found) == [("email", 44, 59)]
    assert pii.find_personal_data(no_rows).count() == 0


def test_redaction():
    assert pii.redact("abcdefgh", [(4, 6), (1, 3), (2, 5)]) == "a[PRIVATE]gh"
    assert pii.redact("abc", []) == "abc"


def test_all_proposals_count(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(pii, "written", lambda table, name: counted.append(table.count()) or table)
    docs = spark.range(60_000).selectExpr("id as doc_id", "'call +1 (212) 555-0182' as text")
    pii.train(pii.texts(docs))
    assert counted == [60_000]


def test_lowest_scores_against_a_plain_search(spark):
    random.seed(5)
    rows = [(g, float(random.random() < s), s) for g in (0, 2) for s in random.choices([0.0, 1.0, *(i / 7 for i in range(8)), *(i / 997 for i in range(997))], k=400)]
    rows += [(1, 0.0, 0.5)] * 3
    judged = spark.createDataFrame(rows, "generator int, label double, score double").repartition(3)
    for precision in (0.5, 0.8, 0.95):
        want = {}
        for g, _, s in rows:
            above = [label for h, label, x in rows if h == g and x >= s]
            if sum(above) / len(above) >= precision:
                want[g] = min(want.get(g, s), s)
        assert pii.lowest_scores(judged, precision) == want
