"""Centroid clustering of integer vectors with an equal-average, equal-variance nearest-centroid search.

1. Vectors of the right size whose components are all finite become integers, ``floor(scale * x)``, and are written once
   to the shared folder; every round reads that table.
2. The first centroids are the vectors whose ids have the least hashes: a top-k of Spark, no sort of the table.
3. *Search.* Centroids are sorted by their component mean. A vector starts at its own mean and goes outward, the nearer
   side first. With ``k`` components, means ``m`` and deviations ``v = sqrt(sum (x - m)^2)``, the squared distance is at
   least ``k (m_x - m_c)^2``, and with the deviations at least ``k (m_x - m_c)^2 + (v_x - v_c)^2``. The first bound ends
   the search, as means further out are no nearer; the second passes over a centroid. Bounds are compared with a margin
   for the error of floating point, and a centroid that may tie is looked at; distances are exact integers, the least
   number wins among equal ones.
4. A task sums what it has assigned and emits a row for each centroid, Spark adds these up, and the driver gets one row
   for each centroid: its size is the number of centroids, whatever the input.

A vector that is null, has another number of components, or a null or non-finite one, is left out. A missing id hashes as
an empty one, and vectors with one id are told apart by their components; each row is clustered for itself. Fewer vectors than
centroids give fewer centroids; an empty table gives an empty result. Components beyond 2^27 after scaling are refused: their
distances would not fit a long. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailtriage.llm.tables import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = "2"
GREATEST = 1 << 27
MARGIN = 1e-7  # of the squared lengths; floating point errs by less
TOGETHER = 4096  # vectors


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """``vec_id, vector``: the vectors that count, as little-endian 32-bit integers."""
    x = F.col(vector_col)
    whole = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            values = np.floor(values * scale)
            if np.abs(values).max() > GREATEST:
                raise ValueError(f"a component beyond {GREATEST // scale} gives distances that do not fit a long")
            packed = np.ascontiguousarray(values.astype("<i4")).view(f"V{4 * size}").ravel().tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([bytes(v) for v in packed], pa.binary())], names=["vec_id", "vector"]
            )

    kept = table.where(F.coalesce(whole, F.lit(False)))
    picked = kept.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("vector"))
    return picked.mapInArrow(work, "vec_id long, vector binary")


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name, 256), "vector").limit(k).collect()
    return np.array([np.frombuffer(r.vector, "<i4") for r in rows], np.int64)


class Search:
    """The nearest of some centroids, for many vectors at a time."""

    def __init__(self, centroids: np.ndarray):
        self.by_mean = np.argsort(centroids.sum(1), kind="stable")
        self.centroids = centroids[self.by_mean]
        self.sums, self.deviations, self.lengths = self._described(self.centroids)
        self.distances_taken = 0

    @staticmethod
    def _described(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum of the components, deviation, squared length."""
        sums = x.sum(1)
        lengths = np.einsum("ij,ij->i", x, x).astype(np.float64)
        return sums, np.sqrt(np.maximum(0, lengths - sums.astype(np.float64) ** 2 / x.shape[1])), lengths

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of, and exact squared distance to, the nearest centroid of each row."""
        n, size = x.shape
        k = len(self.centroids)
        sums, deviations, lengths = self._described(x)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k)
        at = np.arange(n)
        while len(at):
            left, right = low[at], high[at]
            below = np.where(left >= 0, sums[at] - self.sums[np.maximum(left, 0)], np.iinfo(np.int64).max)
            above = np.where(right < k, self.sums[np.minimum(right, k - 1)] - sums[at], np.iinfo(np.int64).max)
            here = np.where(below <= above, left, right)
            gap = np.minimum(below, above).astype(np.float64) ** 2 / size
            margin = MARGIN * (lengths[at] + self.lengths[here])
            going = gap - margin <= best[at]
            at, here, gap, margin = at[going], here[going], gap[going], margin[going]
            bound = gap + (deviations[at] - self.deviations[here]) ** 2
            near = np.flatnonzero(bound - margin <= best[at])
            self.distances_taken += len(near)
            rows, chosen = at[near], here[near]
            apart = x[rows] - self.centroids[chosen]
            distance = np.einsum("ij,ij->i", apart, apart)
            own = self.by_mean[chosen]
            better = (distance < best[rows]) | ((distance == best[rows]) & (own < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], own[better]
            went_low = here == low[at]
            low[at[went_low]] -= 1
            high[at[~went_low]] += 1
            at = at[(low[at] >= 0) | (high[at] < k)]
        return number, best


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(start, TOGETHER)
            yield part, np.frombuffer(b"".join(part.column("vector").to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, n, sums``: a row for each task and centroid that it has assigned vectors to."""
    k, size = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n, sums = Search(centroids), np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, x in _batches(batches, size):
            number, _ = search.nearest(x)
            n += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            found, first = np.unique(number[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], first)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    return vectors.select("vector").mapInArrow(work, "cluster int, n long, sums array<long>")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of what is nearest to each; those of nothing stay."""
    size = centroids.shape[1]
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
    out = centroids.copy()
    for row in _sums(vectors, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance``."""
    size = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for part, x in _batches(batches, size):
            number, distance = search.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return vectors.mapInArrow(work, "vec_id long, cluster int, distance long")


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    size: int = SIZE,
    scale: int = SCALE,
    seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that counts, and the
    final centroids."""
    vectors = written(integer_vectors(table, id_col, vector_col, size, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        centroids = np.zeros((1, size), np.int64)  # there is nothing to assign
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = written(assigned(vectors, centroids), "assigned-vectors")
    inertia = {r.cluster: r.inertia for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}

    def of_cluster(values: list) -> Column:
        return F.get(F.array(*(F.lit(v) for v in values)), F.col("cluster"))

    own = [inertia.get(i, 0) for i in range(len(centroids))]
    return (
        found.select(
            "vec_id",
            "cluster",
            "distance",
            of_cluster(own).cast("long").alias("cluster_inertia"),
            F.lit(sum(own)).cast("long").alias("inertia"),
            of_cluster([centroid_digest(c) for c in centroids]).alias("centroid_sha256"),
        ),
        centroids,
    )
