from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece

from mailtriage.llm import token_counts as t
from mailtriage.llm.queries import op13_token_counts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=t.default_model())


@pytest.fixture(scope="module")
def counter():
    return t.Transducer(t.default_model())


def lengths(library, texts):
    return [len(x) for x in library.encode(texts)]


def hard_texts(counter, n=1500):
    rng = random.Random(5)
    pieces = list(counter.pieces.score)
    makers = [
        lambda: "".join(rng.choice("ab x ") for _ in range(rng.randint(0, 60))),
        lambda: "".join(rng.choice(counter.characters) for _ in range(rng.randint(0, 20))),
        lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))).replace(t.SPACE, " "),
        lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(0, 2000))),
        lambda: rng.choice(["x", "=", "-", " ", "0", " -", "ha", t.SPACE, "er"]) * rng.randint(1, 2500),
        lambda: chr(rng.randrange(1, 0xD7FF)) * rng.randint(0, 4) + chr(rng.randrange(0x10000, 0x10FFFF)) + "<s></s><unk>\0\t\n",
    ]
    return [rng.choice(makers)() for _ in range(n)]


def test_query(spark, table, library):
    rows = table("documents").collect()
    want = {r.doc_id: (len(r.text.encode()), n) for r, n in zip(rows, lengths(library, [r.text for r in rows]), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (b, n, n > 4096) for i, (b, n) in want.items()}


def test_random_texts(counter, library):
    texts = hard_texts(counter)
    assert counter.count(texts).tolist() == lengths(library, texts)


def test_one_text_at_a_time_counts_the_same(counter):
    texts = hard_texts(counter, 60)
    assert counter.count(texts).tolist() == [int(counter.count([x])[0]) for x in texts]


def test_states_that_no_map_foresaw(library, monkeypatch):
    """With no characters read ahead, chunks inside a stretch start from guesses that are wrong."""
    monkeypatch.setattr(t, "BEFORE", 0)
    monkeypatch.setattr(t, "CHUNK", 61)
    counter = t.Transducer(t.default_model())
    counter.pieces.longest = 1
    texts = ["x" * 1000, "etaoinshrdlu" * 100, "a b", " " * 777]
    assert counter.count(texts).tolist() == lengths(library, texts)


def test_maps_are_composed(counter, library, monkeypatch):
    """A stretch of many chunks is read in parallel: no lane is as long as the stretch."""
    longest = []
    read = counter.read
    monkeypatch.setattr(counter, "read", lambda text, barrier, start, end, states: longest.append(max(end - start)) or read(text, barrier, start, end, states))
    text = "etaoinshrdlu" * 5000
    assert counter.count([text]).tolist() == lengths(library, [text])
    assert max(longest) < 3 * t.CHUNK


def test_a_full_table_is_emptied(library, monkeypatch):
    monkeypatch.setattr(t, "MOST_STATES", 200)
    counter = t.Transducer(t.default_model())
    texts = ["the quick brown fox jumps over the lazy dog", "een twee drie vier vijf zes zeven", "x" * 900] * 2
    for x in texts:
        assert counter.count([x]).tolist() == lengths(library, [x])
    assert counter.held < 1000


def test_awkward_rows(awkward, no_rows, library):
    rows = awkward.collect()
    want = [(r.doc_id, len((r.text or "").encode()), n) for r, n in zip(rows, lengths(library, [r.text or "" for r in rows]), strict=True)]
    got = [(r.doc_id, r.n_bytes, r.n_tokens) for r in t.count_tokens(awkward).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert t.count_tokens(no_rows).count() == 0
    assert t.Transducer(t.default_model()).count([]).tolist() == np.zeros(0).tolist()
