from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from mailtriage.llm import centroids as c


def brute_force(rows, k, rounds, size=4, scale=256):
    """Plain integers. ``rows``: (id, vector); the result is sorted."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    signed = lambda v: b"".join(x.to_bytes(4, "little", signed=True) for x in v)
    middle = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), signed(r[1])))[:k]]
    apart = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    near = lambda v: min((apart(v, m), n) for n, m in enumerate(middle))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else m for n, m in enumerate(middle)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    own: dict = {}
    for _, n, d in found:
        own[n] = own.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted([(i, n, d, own[n], sum(own.values()), sha[n]) for i, n, d in found], key=repr)


def result(frame):
    return sorted([tuple(r) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    around = rng.normal(0, 3, (6, 4))
    rows = [(i, (around[i % 6] + rng.normal(0, 0.5, 4)).tolist()) for i in range(400)]
    rows += [(400 + i, [0.0, 0.0, 0.0, 0.0]) for i in range(200)]  # ties: one vector for a third of the rows
    rows += [(600 + i, [float(i % 3), float(i % 2), 1.0, 1.0]) for i in range(60)]
    rows += [(1, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0]), (None, [4.0, 3.0, 2.0, 1.0])]
    bad = [None, [], [1.0, 2.0, 3.0], [1.0] * 5, [1.0, None, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0], [float("inf")] * 4]
    return rows + [(900 + i, v) for i, v in enumerate(bad)]


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, vector string, cluster int").repartition(3)


@pytest.mark.parametrize("k, rounds", [(9, 3), (1, 2), (40, 0)])
def test_against_brute_force(spark, vectors, k, rounds):
    found, _ = c.cluster_vectors(frame(spark, vectors), k=k, rounds=rounds, size=4)
    assert result(found) == brute_force(vectors, k, rounds)


def test_few_or_no_vectors(spark, vectors):
    few = vectors[:3]
    found, middle = c.cluster_vectors(frame(spark, few), k=9, rounds=2, size=4)
    assert result(found) == brute_force(few, 9, 2) and len(middle) == 3
    for rows in (vectors[-7:], []):
        assert c.cluster_vectors(frame(spark, rows), k=9, rounds=2, size=4)[0].count() == 0


def test_search_is_exact_and_looks_at_few():
    rng = np.random.default_rng(7)
    middle = rng.integers(-2000, 2000, (200, 1)) + rng.integers(-90, 90, (200, 16))
    x = middle[rng.integers(0, 200, 3000)] + rng.integers(-20, 20, (3000, 16))
    x = np.concatenate([x, middle[:50], np.full((5, 16), c.GREATEST), np.full((5, 16), -c.GREATEST)])
    middle = np.concatenate([middle, middle[:20]])
    search = c.Search(middle)
    number, distance = search.nearest(x)
    every = ((x[:, None, :] - middle[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert search.distances_taken < 0.05 * every.size


def test_too_large(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        c.cluster_vectors(frame(spark, [(1, [1e7, 0.0, 0.0, 0.0])]), size=4)[0].collect()
