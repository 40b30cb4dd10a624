"""Centroid clustering of whole-number vectors: Ptolemaic bounds from pivot distances, survivors checked exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwell.llm.shared import staged

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Larger whole numbers could overflow a squared distance of 64 components in 64 bits.
LARGEST = 1 << 27
PIVOTS = 8
#: Vectors looked at together; survivors of so many take at most BLOCK x clusters x components numbers.
BLOCK = 1024
#: More than the rounding of a square root, two products and their difference, as a share of the products.
SLACK = 2.0 ** -49

SUMS = "cluster int, component int, total long, members long"
ASSIGNED = "vec_id long, cluster int, distance long"


def whole_numbers(vectors: DataFrame, components: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the rows with exactly ``components`` usable entries x: v holds floor(scale * x)."""
    given = F.col("embedding").cast("array<double>")
    usable = (F.size(given) == components) & F.forall(given, lambda x: x.isNotNull() & (F.abs(F.floor(x * F.lit(float(scale)))) <= LARGEST) & ~F.isnan(x))
    v = F.transform(given, lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(lists: pa.Array, components: int, kind=np.int64) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, components)


def squared(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    gap = one - other
    return np.einsum("ij,ij->i", gap, gap)


def pivot_rows(seeds: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Seeds far from each other: the first, then always the one farthest from those taken. They stay for all rounds."""
    taken = [0]
    while len(taken) < min(count, len(seeds)):
        gaps = np.min([((seeds - seeds[t]).astype(float) ** 2).sum(axis=1) for t in taken], axis=0)
        if gaps.max() == 0:
            break
        taken.append(int(gaps.argmax()))
    return seeds[taken]


def with_pivot_distances(pivots: np.ndarray):
    """Add each vector's distances to the pivots, kept for every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch["v"], pivots.shape[1])
            near = np.stack([np.sqrt(squared(v, p).astype(float)) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(pivots), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], lists], ["vec_id", "v", "pivots"])

    return run


class Assigner:
    """Nearest of some centroids by squared distance, ties to the smaller number.

    For pivots p and q, Ptolemy's inequality gives d(x, c) d(p, q) >= |d(x, p) d(c, q) - d(x, q) d(c, p)|. The bound is
    lowered by more than its rounding, so a centroid it rules out is truly farther than one already measured.
    """

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.own = np.stack([np.sqrt(squared(centroids, p).astype(float)) for p in pivots], axis=1)
        apart = [(p, q, float(np.sqrt(squared(pivots[p:p + 1], pivots[q])[0]))) for p in range(len(pivots)) for q in range(p)]
        self.pairs = [(p, q, gap) for p, q, gap in apart if gap > 0]

    def bounds(self, near: np.ndarray) -> np.ndarray:
        """Squared distances that no centroid can be nearer than: one row per vector, one column per centroid."""
        low = np.zeros((len(near), len(self.centroids)))
        for p, q, gap in self.pairs:
            one, two = near[:, p, None] * self.own[:, q], near[:, q, None] * self.own[:, p]
            np.maximum(low, (np.abs(one - two) - (one + two) * SLACK) / (gap * (1 + SLACK)), out=low)
        return low * low * (1 - SLACK)

    def nearest(self, v: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each vector, and how many distances were measured."""
        rows = np.arange(len(v))
        low = self.bounds(near)
        chosen = low.argmin(axis=1)
        best = squared(v, self.centroids[chosen])
        left = low <= np.nextafter(best.astype(float), np.inf)[:, None]
        left[rows, chosen] = False
        row, column = np.nonzero(left)
        if len(row):
            found = np.full(low.shape, np.iinfo(np.int64).max)
            found[rows, chosen] = best
            found[row, column] = squared(v[row], self.centroids[column])
            chosen = found.argmin(axis=1)              # the first of equals has the smaller number
            best = found[rows, chosen]
        return chosen, best, len(v) + len(row)


def blocks(batch: pa.RecordBatch, components: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        v, near = matrix(part["v"], components), part["pivots"].flatten().to_numpy(zero_copy_only=False)
        yield part, v, near.reshape(len(v), -1)


def partial_sums(assigner: Assigner):
    """One row per cluster and component of a task's vectors: their sum and number."""
    count, components = assigner.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, members = np.zeros((count, components), dtype=np.int64), np.zeros(count, dtype=np.int64)
        for batch in batches:
            for _, v, near in blocks(batch, components):
                chosen, _, _ = assigner.nearest(v, near)
                np.add.at(totals, chosen, v)
                members += np.bincount(chosen, minlength=count)
        place = np.indices((count, components), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place[0].ravel()), pa.array(place[1].ravel()), pa.array(totals.ravel()), pa.array(np.repeat(members, components))],
                                         ["cluster", "component", "total", "members"])

    return run


def assigned(assigner: Assigner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, v, near in blocks(batch, assigner.centroids.shape[1]):
                chosen, best, _ = assigner.nearest(v, near)
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(chosen, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def seed_order() -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = 64) -> DataFrame:
    """One row per vector of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, null, or with a null or non-finite entry take no part, nor do those with an entry
    beyond 2**27 / 64, whose distances could overflow. Entries x count as floor(64 * x). Centroids start as the
    vectors with the smallest sha256 of ``1:<vec_id>`` (equal ids by their vectors; rows without vec_id never start
    one, but are assigned like the others); with fewer vectors there are fewer clusters, with none there are no rows.
    Each of ``rounds`` rounds assigns every vector and moves every centroid that has vectors to the floor of their
    mean; then all are assigned once more. Distances are squared, ties go to the smaller number, and equal rows each
    count. A total that 64 bits cannot hold is null. Other columns are ignored.

    The driver holds the centroids and their sums only: ``clusters`` times ``components`` numbers.
    """
    kept = whole_numbers(vectors, components)
    first = kept.filter(F.col("vec_id").isNotNull()).orderBy(seed_order(), "vec_id", "v").select("v").limit(clusters).collect()
    if not first:
        empty = kept.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
        return empty.limit(0)
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    pivots = pivot_rows(centroids)
    cached = staged(kept.mapInArrow(with_pivot_distances(pivots), "vec_id long, v array<int>, pivots array<double>"))
    for _ in range(rounds):
        parts = cached.mapInArrow(partial_sums(Assigner(centroids, pivots)), SUMS)
        sums = parts.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
        centroids = centroids.copy()
        for r in sums.filter("members > 0").collect():
            centroids[r["cluster"], r["component"]] = r["total"] // r["members"]
    found = staged(cached.mapInArrow(assigned(Assigner(centroids, pivots)), ASSIGNED))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    per_cluster = found.groupBy("cluster").agg(total.alias("_sum"))
    whole = found.agg(total.try_cast("long").alias("inertia")).scalar()
    named = per_cluster.select("cluster", F.col("_sum").try_cast("long").alias("cluster_inertia"), whole.alias("inertia"),
                               F.element_at(F.array(*map(F.lit, names)), F.col("cluster") + 1).alias("centroid_sha256"))
    # one row per cluster
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
