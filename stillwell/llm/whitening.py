"""Whitening by exact principal components: whole-number scatter, its characteristic polynomial, null vectors at its roots."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwell.llm import polynomial

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Entries beyond this have products that the exact sums below cannot hold.
LARGEST = 1 << 31
#: Rows per exact product: 2**10 products of two numbers below 2**21 stay below 2**53, where doubles are whole.
BLOCK = 1 << 10
HALF = 16

MOMENTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])
RESIDUES = "number long, coefficients array<long>"
RESULT = "vec_id long, deviation long, whitened array<double>"


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, y): entries c as floor(64 * c), of rows without null, non-finite or over-large entries and of some length.

    x is y + OFFSET; the offset leaves every centred product as it is, so the work goes on with the smaller y.
    """
    given = F.col("embedding").cast("array<double>")
    usable = (F.size(given) > 0) & F.forall(given, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / SCALE))
    y = F.transform(given, lambda c: F.floor(c * F.lit(float(SCALE))))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), y.alias("y"))


def rows_of(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch["y"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def products(y: np.ndarray) -> list[list[int]]:
    """The exact sums of products of the columns of at most BLOCK rows, by products of doubles that stay whole."""
    if not len(y):
        return [[0] * y.shape[1]] * y.shape[1]
    if np.abs(y).max() < 1 << 21:
        whole = y.astype(float)
        return (whole.T @ whole).astype(np.int64).tolist()
    high, low = (y >> HALF).astype(float), (y & ((1 << HALF) - 1)).astype(float)
    a, b, c = (part.astype(np.int64).astype(object) for part in (high.T @ high, high.T @ low, low.T @ low))
    return ((a << 2 * HALF) + ((b + b.T) << HALF) + c).tolist()


def moments(d: int):
    """A task's exact sums: of y_i y_j for j <= i, and of y_i as j = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = np.zeros((d, d), dtype=object)
        single = np.zeros(d, dtype=object)
        for batch in batches:
            y = rows_of(batch, d)
            for at in range(0, len(y), BLOCK):
                square += np.array(products(y[at:at + BLOCK]), dtype=object)
                single += y[at:at + BLOCK].sum(axis=0).astype(object)
        i, j = np.tril_indices(d)
        totals = [*square[i, j], *single]
        places = [np.concatenate([i, np.arange(d)]), np.concatenate([j, np.full(d, -1)])]
        yield pa.RecordBatch.from_arrays([*[pa.array(p, pa.int32()) for p in places], pa.array([Decimal(int(t)) for t in totals], pa.decimal128(38, 0))], schema=MOMENTS)

    return run


def scatter(fit: DataFrame, d: int, n: int) -> tuple[list[list[int]], list[int]]:
    """n**2 times the covariance of the d columns, and the columns' sums, both exact: d * (d + 3) / 2 numbers on the driver."""
    parts = fit.mapInArrow(moments(d), "i int, j int, total decimal(38,0)")
    found = {(r["i"], r["j"]): int(r["total"]) for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    sums = [found[i, -1] for i in range(d)]
    return [[n * found[max(i, j), min(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)], sums


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Exact coefficients of det(xI - m), constant term first, for positive semidefinite m; tasks take the primes."""
    # twice the bound, since a coefficient may have either sign
    primes = polynomial.primes_beyond(2 * polynomial.coefficient_bound(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch["id"].to_pylist()
            if numbers:
                rest = polynomial.polynomials_mod(m, [primes[k] for k in numbers])
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rest.tolist(), pa.list_(pa.int64()))], ["number", "coefficients"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rest = {r["number"]: r["coefficients"] for r in spark.range(0, len(primes), 1, tasks).mapInArrow(run, RESIDUES).collect()}
    return [polynomial.from_residues([rest[n][k] for n in range(len(primes))], primes) for k in range(len(m) + 1)]


def long_double(value: int, bits: int = 0) -> np.longdouble:
    return np.ldexp(np.longdouble(str(value)), -bits)


class Whitening:
    """The components of a fit list: exact sums, unit eigenvectors of its covariance, and their eigenvalues, largest first."""

    def __init__(self, spark: SparkSession, m: list[list[int]], sums: list[int], n: int, components: int):
        self.n, self.sums = n, sums
        coefficients = characteristic(spark, m)
        square = long_double(n * n)
        roots = np.array([long_double(*root) for root in polynomial.real_roots(coefficients, components)]) / square
        covariance = np.array([[long_double(v) for v in row] for row in m]) / square
        self.vectors = polynomial.null_vectors(covariance, roots).astype(float)
        self.values = roots.astype(float)
        self.trace = float(np.trace(covariance))
        self.live = self.values > 0
        self.divisors = np.sqrt(np.where(self.live, self.values, 1.0))

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        limit = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums))
        if limit < 1 << 62:
            return self.n * y - np.array(self.sums, dtype=np.int64)
        return self.n * y.astype(object) - np.array(self.sums, dtype=object)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        largest = int(np.abs(centred).max(initial=0))
        if centred.dtype != object and largest ** 2 * centred.shape[1] < 1 << 63:
            return np.einsum("ij,ij->i", centred, centred).tolist()
        totals = [sum(v * v for v in row) for row in centred.astype(object).tolist()]
        return [t if t < 1 << 63 else None for t in totals]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Each row's coordinates on the components over the roots of their eigenvalues; NaN where that is 0."""
        out = (centred.astype(float) / self.n) @ self.vectors / self.divisors
        out[:, ~self.live] = np.nan
        return out


def coordinate_moments(model: Whitening, d: int):
    """Sums of products of the whitened coordinates of a task's rows, and of each as j = -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = int(model.live.sum())
        square, single = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            w = model.whitened(model.centred(rows_of(batch, d)))[:, model.live]
            square += w.T @ w
            single += w.sum(axis=0)
        i, j = np.tril_indices(count)
        columns = [np.concatenate([i, np.arange(count)]), np.concatenate([j, np.full(count, -1)]), np.concatenate([square[i, j], single])]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2])], ["i", "j", "total"])

    return run


def identity_error(fit: DataFrame, model: Whitening, d: int) -> float | None:
    """Largest entry, in size, of the whitened rows' covariance minus the identity; None without a component of variance."""
    parts = fit.mapInArrow(coordinate_moments(model, d), "i int, j int, total double")
    found = {(r["i"], r["j"]): r["total"] / model.n for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    return max((abs(v - found[i, -1] * found[j, -1] - (i == j)) for (i, j), v in found.items() if j >= 0), default=None)


def projected(model: Whitening, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                centred = model.centred(rows_of(part, d))
                w = model.whitened(centred)
                values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(model.deviations(centred), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return run


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, int]:
    """The rows of ``usable_vectors`` that have the most common length (the smaller of equals), their components, and the length."""
    lengths = fit.groupBy(F.size("y").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return fit, None, 0
    d, n = lengths["d"], lengths["n"]
    fit = fit.filter(F.size("y") == d)
    m, sums = scatter(fit, d, n)
    return fit, Whitening(fit.sparkSession, m, sums, n, min(components, d)), d


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows of ``vectors`` (vec_id, embedding) on the first ``components`` principal components, scaled to variance 1.

    Per row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error. Rows whose
    vector is null, empty, or holds a null, a non-finite entry or one beyond 2**25 take no part, nor do vectors of
    another length than the most common one. Every other row counts, repeated ones too, and those without vec_id.
    deviation is null where 64 bits cannot hold it. A component without variance (constant columns, few rows) has a
    null whitened and explains 0, or null if there is no variance at all; identity_error leaves it out, and is null
    without any other. Eigenvalues of several fold get some basis of their space. An empty table gives no rows.

    The driver holds numbers of the dimensions' count squared, never rows. The polynomial's cost grows with the
    fourth power of that count; its primes are dealt over tasks.
    """
    fit, model, d = fit_whitening(usable_vectors(vectors), components)
    facts = {"n": "long", "explained": "double", "identity_error": "double"}
    if model is None:
        none = fit.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened"), *[F.lit(None).cast(t).alias(c) for c, t in facts.items()])
        return none.limit(0)
    error = identity_error(fit, model, d)
    explained = F.array(*[F.lit(v / model.trace if model.trace > 0 else None).cast("double") for v in model.values.tolist()])
    rows = fit.mapInArrow(projected(model, d), RESULT)
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(explained, F.col("_k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
