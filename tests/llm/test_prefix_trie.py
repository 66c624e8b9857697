from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailtriage.llm import prefix_trie as t


def turn_key(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())


def brute_force(rows):
    own: dict = {}
    for row in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members: dict = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            if path:
                saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode())
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), len(children.get(path, ())), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def table(spark, rows, parts=3):
    more = [(*r, 7, "x", 1, True) for r in rows]
    return spark.createDataFrame(more, "conv_id long, turn long, role string, text string, depth int, g1 string, n_convs int, ends boolean").repartition(parts)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", "a", "b", "à", "c " * 30, "long " * 20_000]
    out = []
    for c in [*range(60), *range(100, 900, 37), -3, -5]:
        if c in (5, 105):
            continue  # heads that are not there
        out += [(c, n, rng.choice(["user", "assistant", None]), rng.choice(texts[:4] if rng.random() < 0.9 else texts)) for n in range(rng.choice([1, 2, 3, 5, 9, 12]))]
    out += [(c, n, "user", f"copied {n}") for c in range(1000, 1300) for n in range(4)]  # a third of all rows: copies
    out += [(1500, rng.choice([None, n, n, 3]), "user", rng.choice(["x", "y", "z"])) for n in range(400)]  # one long one, with ties
    out += [(1501, n, "user", "x") for n in range(30)] + [(1501, 3, "user", "x")] * 5
    out += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    return out


def test_against_brute_force(spark, rows):
    assert result(t.prefix_trie(table(spark, rows))) == brute_force(rows)


def test_a_sketch_without_proofs(spark, rows, monkeypatch):
    """A sketch that is too small proves nothing: every row is grouped, with the same result."""
    monkeypatch.setattr(t, "LEAST_CELLS", 8)
    monkeypatch.setattr(t, "MOST_CELLS", 8)
    assert result(t.prefix_trie(table(spark, rows))) == brute_force(rows)


def test_few_rows(spark):
    for rows in ([], [(None, 1, "user", "x")], [(7, None, None, None)], [(6, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "user", "x")]):
        assert result(t.prefix_trie(table(spark, rows, 2))) == brute_force(rows)


def test_the_sketch_proves_only_what_is_alone(spark):
    rows = spark.range(3000).select(F.xxhash64(F.col("id") % 2000).alias("g1"), F.xxhash64(F.lit(1), F.col("id") % 2000).alias("g2"), F.lit(2).alias("depth"))
    rows = rows.withColumns({"p1": F.col("g1"), "p2": F.col("g2")}).repartition(5)
    width = 1 << 14
    bits = t.sketch(rows, width)
    found = t.screened(rows, width, spark.sparkContext.broadcast(bits)).groupBy("g1").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).collect()
    assert not any(r.alone for r in found if r.n > 1)
    assert np.mean([r.alone for r in found if r.n == 1]) > 0.9


def test_ends_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 4)
    ids = [-9, -4, -1, 0, 1, 3, 4, 5, 17, 1000]
    ending = spark.createDataFrame([(1, 2, 3, c) for c in ids] + [(1, 2, 4, 8)], "g1 long, g2 long, depth long, conv_id long").repartition(3)
    got = {r.depth: r.ends_sha256 for r in t.end_hashes(ending).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"8").hexdigest()}
