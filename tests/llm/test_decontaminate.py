from __future__ import annotations

import itertools
import random

import pytest

from mailtriage.llm import decontaminate as d
from mailtriage.llm.queries import op2_decontaminate


def test_masks_hit_every_window():
    for lost in itertools.combinations(range(d.WINDOW), d.SUBSTITUTIONS):
        agree = set(range(d.WINDOW)) - set(lost)
        assert any(
            all(shift + place in agree for place in mask)
            for mask in d.MASKS
            for shift in range(d.WINDOW - max(mask))
        ), lost


def test_short_mask_hits_every_short_item():
    for n in range(d.SPACED, d.WINDOW):
        ((mask, places),) = d.seeds_of(n)
        for lost in range(n):
            assert any(lost not in {shift + place for place in mask} for shift in range(places)), (n, lost)
        assert places - 1 + max(mask) < n


def brute_force(docs, items):
    """Documents and items that have a window in common."""
    found = set()
    for doc_id, text in docs:
        own = d.words(text)
        for item_id, item in items:
            words = d.words(item)
            if item_id is None or not words:
                continue
            if len(words) < 5:
                if own == words:
                    found.add((doc_id, item_id))
                continue
            window, allowed = (13, 2) if len(words) >= 13 else (len(words), int(len(words) >= 8))
            for i in range(len(own) - window + 1):
                if any(
                    sum(a != b for a, b in zip(own[i : i + window], words[j : j + window], strict=True)) <= allowed
                    for j in range(len(words) - window + 1)
                ):
                    found.add((doc_id, item_id))
                    break
    return found


def pairs(found):
    return {(r.doc_id, r.item_id) for r in found.collect()}


@pytest.fixture(scope="module")
def planted(spark):
    random.seed(12)
    vocabulary = [f"w{i}" for i in range(12)]  # few words: many chance hits
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([3, 5, 9, 13, 14, 20, 40])))) for i in range(25)]
    items += [(3, items[7][1]), (None, items[8][1]), (90, None), (91, "")]
    docs = []
    for i in range(160):
        own = random.choices(vocabulary, k=random.randint(0, 40))
        item = random.choice(items)[1]
        if item and i % 3:
            passage = item.split()
            for at in random.sample(range(len(passage)), min(len(passage), random.randint(0, 4))):
                passage[at] = "Other"
            start = random.randint(0, max(0, len(passage) - 13))
            own[5:5] = [w.upper() + random.choice(["", ",", "!!"]) for w in passage[start:]]
        docs.append((i, " ".join(own)))
    short = random.Random(7)
    for i, n in enumerate([2, 4, 6, 7, 8, 8, 10, 11, 12, 12]):
        passage = short.choices(vocabulary, k=n)
        items.append((200 + i, " ".join(passage)))
        docs.append((1000 + i, " ".join(passage)))
        for j in range(n):
            other = [*passage[:j], "Other", *passage[j + 1 :]]
            docs.append((2000 + 100 * i + j, " ".join(["so", *other, "it"])))
    return docs, items


def test_short_items(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two three four five six"), (3, "lazy dog sleeps")]
    docs = [
        (1, "so alpha beta gamma delta OTHER zeta eta theta it is"),
        (2, "so alpha beta gamma other other zeta eta theta it is"),
        (3, "alpha beta gamma delta epsilon zeta eta"),
        (4, "see: one two three four five six."),
        (5, "one two three 4 five six"),
        (6, "Lazy dog sleeps!"),
        (7, "the lazy dog sleeps"),
        (8, None),
        (9, "Other beta gamma delta epsilon zeta eta theta"),
        (10, "alpha beta gamma delta epsilon zeta eta other"),
    ]
    found = d.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1),
        spark.createDataFrame([*items, (4, "")], "item_id long, text string"),
    )
    assert pairs(found) == {(1, 1), (4, 2), (6, 3), (9, 1), (10, 1)} == brute_force(docs, items)
    assert {(r.start, r.end, r.matched) for r in found.collect() if r.doc_id in (1, 6)} == {(1, 9, 7), (0, 3, 3)}


@pytest.mark.parametrize("most", [300, d.MOST_SEEDS])
def test_against_brute_force(spark, planted, most):
    docs, items = planted
    found = d.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        most_seeds=most,
    )
    want = brute_force(docs, items)
    assert len(want) > 50 and pairs(found) == want
    by_item: dict = {}
    for i, t in items:
        by_item.setdefault(i, []).append(d.words(t))
    texts = {i: d.words(t) for i, t in docs}
    for r in found.collect():
        stretch = texts[r.doc_id][r.start : r.end]
        assert r.matched in {
            sum(a == b for a, b in zip(stretch, words[r.item_start :], strict=False)) for words in by_item[r.item_id]
        }


def test_query(spark, documents, table):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    exact = {(i, j) for i, t in docs for j, b in items if b" ".join(d.words(b)) in b" ".join(d.words(t))}
    found = pairs(op2_decontaminate(spark, "/root/testdata/sf0.001"))
    assert exact and exact <= found
    assert found == brute_force([x for x in docs if x[0] in {i for i, _ in found}], items)


def test_awkward_rows(awkward, no_rows, table):
    benchmark = table("benchmark")
    name = benchmark.where("item_id = 0").first().text
    leaked = awkward.selectExpr("*").union(awkward.selectExpr("doc_id", f"concat(coalesce(text, ''), ' {name} end') as text", "key", "slot", "kept", "score", "node"))
    kept = d.drop_contaminated(leaked, benchmark)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert d.drop_contaminated(leaked.withColumnRenamed("key", "found"), benchmark).count() == awkward.count()
    assert d.contaminated(no_rows, benchmark).count() == 0
    assert d.contaminated(leaked, benchmark.where("false")).count() == 0
    assert d.drop_contaminated(leaked, benchmark.where("false")).count() == leaked.count()
