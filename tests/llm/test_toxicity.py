from __future__ import annotations

import random

import numpy as np
import pytest

from mailtriage.llm import toxicity as t
from mailtriage.llm.tables import fold_of, texts


@pytest.mark.parametrize(
    "text, folded",
    [
        ("IDIOT", "idiot"),
        ("1d10t", "idiot"),
        ("іdіоt", "idiot"),
        ("ｉｄｉｏｔ", "idiot"),
        ("i.d.i.o.t!", "idiot!"),
        ("id​iot", "idiot"),
        ("a b", "a b"),
        ("an 1 d 1 o t is", "an idiot is"),
        ("i. d. i. o. t", "i. d. i. o. t"),
        ("über", "über"),
    ],
)
def test_fold(text, folded):
    assert t.fold(text) == folded


def test_matches_against_plain_search():
    random.seed(4)
    weights = {"abcd": 1.0, "abcde": 2.0, "cdab": 4.0, "dcba": 8.0}
    matcher = t.Matcher(weights, {})
    for _ in range(3000):
        text = "".join(random.choices("abcde .,", k=40))
        want = 0.0
        for word in "".join(c if c.isalnum() else " " for c in text).split():
            want += max((w for e, w in weights.items() if word.startswith(e)), default=0.0, key=lambda w: w and len([e for e in weights if weights[e] == w][0]))
        assert sum(weights[e] for e, *_ in matcher.matches(text)) == want


def test_folding_tokens_misses_nothing():
    random.seed(14)
    matcher = t.Matcher({"idio": 1.0, "idiot": 2.0, "clow": 4.0}, {})
    alphabet = ["i", "d", "o", "t", "1", "0", "I", "і", ".", "-", "_", " ", " ", "\n", "\t", "c", "l", "w", "\u200b", "é", ",", "idiot", "clown", "x"]
    found = 0
    for _ in range(20_000):
        text = "".join(random.choices(alphabet, k=random.randint(1, 14)))
        want = sum(matcher.weights[e] for e, *_ in matcher.matches(t.fold(text)))
        found += want > 0
        assert matcher.sums(text) == (want, len(text.split())), text
    assert found > 2000


def test_exception_phrases_take_matches_back():
    matcher = t.Matcher({"clown": 5.0}, {"clown": [">fish"]})
    assert matcher.sums("a clown fish") == (0.0, 3)
    assert matcher.sums("a Cl0wn, fish") == (0.0, 3)
    assert matcher.sums("fish of a clown") == (5.0, 4)


def labelled(spark, n=900):
    random.seed(9)
    words = ["".join(random.choices("aeiou", k=2)) + "".join(random.choices("lmnrst", k=3)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        own = random.choices(words, k=random.randint(20, 60))
        toxic = i % 4 == 0
        if toxic:
            own[3:3] = random.sample(["stinker", "stinkerly", "b0zoman", "bozomane"], 2)
        elif i % 4 == 1:
            own[2:2] = ["bozoman", "circus"]
        docs.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_entries_and_exceptions(spark):
    docs, labels = labelled(spark)
    model = t.learn(docs, labels)
    assert any("stinker".startswith(e) for e in model.weights)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = t.score_documents(docs, model).collect()
    held = [r for r in rows if fold_of(r.doc_id, 3) == 1]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97
    kept = t.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_near_copies_take_no_entry_away(spark):
    docs, labels = labelled(spark, 400)
    held = [i for i in range(5000, 20_000) if fold_of(i, 3) != 1][:1500]
    copies = [(i, f"stinkerly and bozomane in {n} of the same lines again and again") for n, i in enumerate(held)]
    docs = docs.union(spark.createDataFrame(copies, docs.schema))
    labels = labels.union(spark.createDataFrame([(i, 1, 1) for i in held], labels.schema))
    model = t.learn(docs, labels)
    assert any("stinker".startswith(e) for e in model.weights)
    toxic = {r.doc_id: r.toxic for r in labels.where("doc_id < 5000").collect()}
    rows = [r for r in t.score_documents(docs, model).collect() if r.doc_id in toxic and fold_of(r.doc_id, 3) == 1]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in rows]) > 0.97


def test_near_copies_have_one_vote(spark):
    rows = [(f"line {n} of near copies: what a stinker he is", 1) for n in range(50)] + [("a stinker", 1), ("my stinker", 0)]
    votes = t._votes(spark.createDataFrame(rows, "text string, toxic int"), ["stin", "none"]).collect()
    assert sorted((r.term, r.toxic, r.n) for r in votes) == [(0, False, 1), (0, True, 2)]


def test_held_out_accuracy(spark, table):
    docs, labels = table("documents", "/root/testdata/sf0.1"), table("labels", "/root/testdata/sf0.1")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = t.score_documents(docs, t.learn(texts(docs), labels)).collect()
    held = [r for r in rows if r.doc_id in toxic and fold_of(r.doc_id, 3) == 1]
    found = sum(r.predicted for r in held if toxic[r.doc_id])
    assert found >= 0.9 * sum(toxic[r.doc_id] for r in held)
    assert sum(r.predicted for r in held if not toxic[r.doc_id]) <= 0.01 * len(held)


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.selectExpr("doc_id", "quality", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1 then 1 - toxic else toxic end as toxic")
    assert t.learn(docs, labels) == t.learn(docs, flipped)


def test_awkward_rows(spark, awkward, no_rows):
    docs, labels = labelled(spark, 300)
    model = t.learn(docs, labels.union(spark.createDataFrame([(None, 1, 1), (0, 1, None), (0, 1, 0)], labels.schema)))
    rows = t.score_documents(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert t.score_documents(no_rows, model).count() == 0
    assert t.drop_toxic(no_rows, model).count() == 0
    assert t.learn(docs, labels.where("false")) == t.Model()
    assert t.learn(docs.where("false"), labels) == t.Model()
