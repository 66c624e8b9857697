from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mailtriage.llm import packing as p
from mailtriage.llm.queries import op4_best_two_fit


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, p.END_ID]


def valid(rows, capacity):
    """Pieces of a sequence follow each other without a gap and fit it."""
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_same_ids_as_the_tokenizer(tokenizer):
    random.seed(6)
    encoding = p.load_encoding(p.tokenizer_path())
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "ß", "你", "😀", "́", "12", ".", "!?", "<|endoftext|>", "\xa0", " ", "\x00", "\x1c", "ﬁ", "Ⅷ", "A"]
    texts = ["", "x" * 20_000, " " * 5000, "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n <|endoftext|", *("".join(random.choices(alphabet, k=random.randint(1, 30))) for _ in range(4000))]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert p.encoded(encoding, text) == want.ids, text


def sequential(counts, capacity):
    """Best-two-fit bin by bin."""
    left, bins = list(counts), []
    while any(left[1:]):
        own, gap = [], capacity
        while size := next((n for n in range(min(gap, len(left) - 1), 0, -1) if left[n]), 0):
            own.append(size)
            left[size] -= 1
            gap -= size
        if gap:
            small, best = own[-1], (0, 0, 0)
            for a in range(1, len(left)):
                for b in range(1, a + 1):
                    if a + b <= gap + small and left[a] and left[b] and (a != b or left[a] > 1):
                        best = max(best, (a + b, -a, b), key=lambda x: x[0])
            if best[0] > small:
                own = own[:-1] + [-best[1], best[2]]
                left[small] += 1
                left[-best[1]] -= 1
                left[best[2]] -= 1
        bins.append(sorted(own, reverse=True))
    return bins


def test_plan_is_best_two_fit():
    random.seed(8)
    for _ in range(60):
        capacity = random.randint(8, 24)
        counts = [0] + [random.choice([0, 0, 1, 2, 5, 40]) for _ in range(capacity)]
        runs = p.plan(counts, capacity)
        used = Counter()
        for pattern, repeat in runs:
            assert 0 < sum(pattern) <= capacity
            for size in pattern:
                used[size] += repeat
        assert [used[n] for n in range(1, capacity + 1)] == counts[1:]
        want = sequential(counts, capacity)
        assert abs(sum(r for _, r in runs) - len(want)) <= 1
        assert runs[0][0] == want[0]


def test_swap_beats_greedy():
    counts = [0] * 11
    for n in (6, 3, 2, 2):
        counts[n] += 1
    assert p.fill(counts, 10) == ([6, 2, 2], 3)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 3000])
def test_cut(n):
    pieces = p.cut(n, 1024)
    assert [a for a, _ in pieces] == [sum(x for _, x in pieces[:i]) for i in range(len(pieces))]
    assert sum(x for _, x in pieces) == n and all(x == 1024 for _, x in pieces[1:]) and 0 < pieces[0][1] <= 1024


def check(found, source, tokenizer, capacity=1024):
    rows = found.collect()
    valid(rows, capacity)
    want = Counter()
    for doc_id, text in source:
        ids = np.array(ids_of(tokenizer, text), "<u4")
        for i, (a, n) in enumerate(p.cut(len(ids), capacity)):
            want[doc_id, i, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return rows


def test_query(spark, documents, tokenizer):
    rows = check(op4_best_two_fit(spark, "/root/testdata/sf0.001"), [(r.doc_id, r.text) for r in documents.collect()], tokenizer)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * -(-total // 1024) + 1


def test_awkward_rows(awkward, no_rows, tokenizer):
    short = awkward.where("doc_id is null or doc_id not in (7, 8)")
    check(p.pack_documents(short, most=16), [(r.doc_id, r.text) for r in short.collect()], tokenizer, 16)
    rows = p.pack_documents(awkward, with_ids=True).collect()
    valid(rows, 1024)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert p.pack_documents(no_rows).count() == 0
