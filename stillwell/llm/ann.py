"""Nearest neighbours by collision counting: sorted projections, query-centred windows, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Projections per block, the half width of a window at radius 1, the share of projections that a vector must collide
#: in, and the growth of the radius. A vector at the radius collides in a window with chance 0.838, so it passes the
#: threshold of 0.77 in 128 projections with a chance of 0.98; nearer ones nearly always do.
PROJECTIONS = 128
HALF_WIDTH = 1.4
THRESHOLD = 0.77
GROWTH = 1.15
FIRST_RADIUS = 0.25
#: No two unit vectors are farther apart.
LAST_RADIUS = 2.0

FOUND = "query_id long, vec_id long, score double"
FOUND_FIELDS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Projected:
    """A block of vectors as sorted arrays, one per random direction."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        values = (vectors / self.norms[:, None]) @ self.directions
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        #: arrays one after the other, far enough apart that one search serves all
        self.step = 4 * float(np.abs(self.directions).sum(axis=0).max()) + 4
        self.shift = np.arange(PROJECTIONS) * self.step
        self.flat = (np.sort(values, axis=0).T + self.shift[:, None]).ravel()
        self.places = self.order.ravel()

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosines in double precision; every row is summed in the same order, so equal vectors tie."""
        return (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * np.sqrt((query * query).sum()))

    def nearest(self, query: np.ndarray, own: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``count`` nearest found, ties to smaller ids; ``own`` marks rows that do not count.

        Windows around the query grow by virtual rehashing, only their new ends are counted, and every vector that
        reaches the threshold is verified. It ends when ``count`` verified vectors lie within the radius.
        """
        size = len(ids)
        centre = (query / np.sqrt((query * query).sum())) @ self.directions + self.shift
        collisions = np.zeros(size, dtype=np.int64)
        checked = own.copy()
        low = high = np.searchsorted(self.flat, centre)
        rows, cosines, radius = np.zeros(0, dtype=np.int64), np.zeros(0), FIRST_RADIUS
        edges = np.arange(PROJECTIONS) * size
        while True:
            last = radius >= LAST_RADIUS
            if last:
                fresh = np.flatnonzero(~checked)
            else:
                reach = HALF_WIDTH * radius
                left = np.maximum(np.searchsorted(self.flat, centre - reach), edges)
                right = np.minimum(np.searchsorted(self.flat, centre + reach, side="right"), edges + size)
                spans = [self.places[a:b] for a, b in zip(left.tolist(), low.tolist()) if a < b]
                spans += [self.places[a:b] for a, b in zip(high.tolist(), right.tolist()) if a < b]
                low, high = np.minimum(left, low), np.maximum(right, high)
                if spans:
                    collisions += np.bincount(np.concatenate(spans), minlength=size)
                fresh = np.flatnonzero((collisions >= THRESHOLD * PROJECTIONS) & ~checked)
            if len(fresh):
                checked[fresh] = True
                rows = np.concatenate([rows, fresh])
                cosines = np.concatenate([cosines, self.scores(query, fresh)])
                best = np.lexsort((ids[rows], -cosines))[:count]
                rows, cosines = rows[best], cosines[best]
            within = len(rows) == count and 2 - 2 * cosines[-1] <= radius * radius
            if last or within or checked.all():
                return rows, cosines
            radius *= GROWTH


def search_block(count: int):
    """Search one block of vectors for one block of queries."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(queries) or not len(vectors):
            return FOUND_FIELDS.empty_table()

        def matrix(table: pa.Table) -> np.ndarray:
            flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.astype(np.float64).reshape(len(table), -1)

        ids = vectors["vec_id"].to_numpy()
        block = Projected(matrix(vectors))
        out = []
        for name, query in zip(queries["vec_id"].to_pylist(), matrix(queries)):
            rows, cosines = block.nearest(query, ids == name, ids, count)
            out.append((np.full(len(rows), name), ids[rows], cosines))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=FOUND_FIELDS)

    return run


def nearest_vectors(vectors: DataFrame, every: int = 50, count: int = 5, vector_block: int = 8192, query_block: int = 1024) -> DataFrame:
    """The ``count`` nearest of all other ``vectors`` (vec_id, embedding) for those with vec_id divisible by ``every``.

    Rows: query_id, rank (from 1), vec_id, score (cosine in double precision), nearest first, ties to the smaller
    vec_id. Vectors that are null, zero, or hold a null or a number that is not finite take no part, nor rows without
    vec_id; vectors of different lengths are never neighbours. Of rows with one vec_id, the one with the smallest
    vector takes part. With fewer candidates all are returned; an empty table gives no rows.

    Every block of vectors is searched for every block of queries, by blocks of bounded size, and the best of the
    blocks are ranked; a block's index is built where it is searched.
    """
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    # NaN is larger than infinity in Spark's order, so the comparison leaves it out
    clean = clean.filter(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    clean = clean.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = vectors.count()
    blocks, query_blocks = max(1, -(-rows // vector_block)), max(1, -(-rows // (every * query_block)))

    def dealt(df: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        df = df.withColumn("width", F.size("vector")).withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(own_blocks)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_blocks - 1).cast("long"))))

    keys = ["width", "block", "query_block"]
    queries = dealt(clean.filter(F.col("vec_id") % every == 0), "query_block", query_blocks, "block", blocks)
    candidates = dealt(clean, "block", blocks, "query_block", query_blocks)
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search_block(count), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")
