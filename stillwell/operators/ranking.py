"""Ranks, row numbers and exact percentiles that never put a whole group into one task.

A plain ``row_number() over (order by ...)`` or ``percentile`` pulls a group through a single task. Here
values are pre-aggregated, cut into ranges whose split points come from one approximate pass, ranked inside a
range and moved up by the row counts of the ranges before it. The result is exact whatever the split points are.
Split points are a scalar subquery of the plan itself: nothing runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import kept


def range_count(df: DataFrame, ranges: int | None = None) -> int:
    return ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_splits(df: DataFrame, value: str, ranges: int) -> Column:
    """Split points of ``value`` for about ``ranges`` equal parts, as an array that is looked up while the query runs."""
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return df.agg(F.percentile_approx(value, shares, F.lit(4 * ranges)).alias("splits")).scalar()


def with_range(df: DataFrame, value: str, splits: Column | None, ranges: int, name: str = "_range") -> DataFrame:
    """Number of the range that holds ``value``, by halving; larger values never get a smaller number."""
    if ranges < 2 or splits is None:
        return df.withColumn(name, F.lit(0))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((ranges - 1).bit_length()))])
    cut = df.withColumn("_splits", splits).withColumn("_v", F.col(value))

    def halve(low: Column, step: Column) -> Column:
        return F.when(F.get(F.col("_splits"), low + step - 1) < F.col("_v"), low + step).otherwise(low)

    return cut.withColumn(name, F.aggregate(steps, F.lit(0), halve)).drop("_splits", "_v")


def counted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct ``(keys, value)`` with ``rows``, kept: the steps after it read them several times."""
    return kept(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("rows")))


def cumulative_counts(counted: DataFrame, keys: list[str], value: str, ranges: int | None = None) -> DataFrame:
    """Adds to counted values the rows ``before`` each one in its group and the group's ``total``.

    ``counted`` has one row per ``(keys, value)`` with ``rows``. Ranges split distinct values, so a value that
    half of all rows share is still one row here.
    """
    ranges = range_count(counted, ranges)
    counted = counted.select(*keys, value, "rows")
    cut = with_range(counted, value, range_splits(counted, value, ranges) if ranges > 1 else None, ranges)
    # at most one row per group and range, so these windows stay small
    per_range = cut.groupBy(*keys, "_range").agg(F.sum("rows").alias("_in_range"))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    per_range = per_range.select(
        *keys, "_range",
        F.coalesce(F.sum("_in_range").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_start"),
        F.sum("_in_range").over(group).alias("total"))
    inside = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (cut.withColumn("_before", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
            .join(per_range, [*keys, "_range"])
            .select(*keys, value, "rows", (F.col("_start") + F.col("_before")).alias("before"), "total"))


def _average_rank() -> Column:
    return F.col("before") + (F.col("rows") + 1) / 2


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Average rank (ties share the mean of their places) of each distinct ``(keys, value)``."""
    ordered = cumulative_counts(counted_values(df, keys, value), keys, value, ranges)
    return ordered.select(*keys, value, _average_rank().alias(name))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float],
                      ranges: int | None = None) -> DataFrame:
    """Linearly interpolated percentiles per group: one column per ``{name: probability}``."""
    ordered = cumulative_counts(counted_values(df, keys, value), keys, value, ranges)

    def at(place: Column) -> Column:
        here = (F.col("before") <= place) & (place < F.col("before") + F.col("rows"))
        return F.max(F.when(here, F.col(value)))

    parts = []
    for name, p in probabilities.items():
        spot = (F.col("total") - 1) * F.lit(float(p))
        parts += [at(F.floor(spot)).alias(f"_lo_{name}"), at(F.ceil(spot)).alias(f"_hi_{name}"),
                  F.max(spot - F.floor(spot)).alias(f"_t_{name}")]
    return ordered.groupBy(*keys).agg(*parts).select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_t_{n}")).alias(n)
        for n in probabilities])


def spearman(df: DataFrame, x: str, y: str, name: str = "spearman", ranges: int | None = None) -> DataFrame:
    """Rank correlation of two columns over the rows where both are known (average ranks for ties).

    Both columns are ranked in one pass, as two groups of one stacked column.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = kept(known.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n")))

    both = F.explode(F.array(*[F.struct(F.lit(c).alias("_axis"), F.col(c).cast("double").alias("_value")) for c in (x, y)]))
    counted = kept(pairs.select("_n", both.alias("_e")).groupBy("_e._axis", "_e._value").agg(F.sum("_n").alias("rows")))
    ranks = kept(cumulative_counts(counted, ["_axis"], "_value", ranges).select("_axis", "_value", _average_rank().alias("_r")))

    def of(column: str, out: str) -> DataFrame:
        return ranks.where(F.col("_axis") == column).select(F.col("_value").alias(out.replace("r", "v")), F.col("_r").alias(out))

    ranked = (pairs.select(F.col(x).cast("double").alias("_vx"), F.col(y).cast("double").alias("_vy"), "_n")
              .join(of(x, "_rx"), "_vx").join(of(y, "_ry"), "_vy"))
    n = F.sum("_n")
    mean = (n + 1) / 2            # every set of average ranks has this mean
    dx, dy = F.sum(F.col("_n") * F.col("_rx") * F.col("_ry")), F.sum(F.col("_n") * F.col("_rx") * F.col("_rx"))
    dz = F.sum(F.col("_n") * F.col("_ry") * F.col("_ry"))
    return ranked.agg(((dx - n * mean * mean) / F.nullif(
        F.sqrt((dy - n * mean * mean) * (dz - n * mean * mean)), F.lit(0.0))).alias(name), n.alias("rows"))


def hashed_order(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """Distinct keys in a fixed pseudo-random order: ``place`` counts from 0, ``entities`` is their number.

    The order is that of ``md5(key|seed)``, and its first three hex digits are the range, so ranges are even.
    """
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    keys = df.select(key).distinct().select(key, digest.alias("_md5")).withColumn("_range", F.substring("_md5", 1, 3))
    sizes = keys.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))       # at most 4,096 rows
    everything = W.partitionBy(F.lit(0))
    sizes = sizes.select(
        "_range", F.sum("_n").over(everything).alias("entities"),
        F.coalesce(F.sum("_n").over(everything.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_md5", key)) - 1
    return keys.withColumn("_place", inside).join(F.broadcast(sizes), "_range").select(
        key, (F.col("_start") + F.col("_place")).alias(name), "entities")


def segmented_row_number(df: DataFrame, keys: list[str], order: str, name: str, rows_per_segment: int = 1_000_000,
                         ) -> DataFrame:
    """Row number from 0 inside each group by a whole-number order column, in segments of that column.

    Also adds ``<name>_of``, the rows of the group. No window holds more than one segment of a group.
    """
    cut = df.withColumn("_segment", F.floor(F.col(order) / F.lit(rows_per_segment)))
    sizes = cut.groupBy(*keys, "_segment").agg(F.count(F.lit(1)).alias("_n"))
    group = W.partitionBy(*keys)
    sizes = sizes.select(
        *keys, "_segment", F.sum("_n").over(group).alias(f"{name}_of"),
        F.coalesce(F.sum("_n").over(group.orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(*keys, "_segment").orderBy(order)) - 1
    return (cut.withColumn("_inside", inside).join(sizes, [*keys, "_segment"])
            .withColumn(name, F.col("_start") + F.col("_inside")).drop("_segment", "_start", "_inside"))


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows in an order that leaves no ties; each task keeps only its own first ``n``."""
    return df.orderBy(*order).limit(n)


def top_overlap(a: DataFrame, b: DataFrame, key: list[str], score: str, n: int, name: str = "overlap") -> DataFrame:
    """How many of the ``n`` highest-scoring keys two rankings share."""
    best = [top_rows(x, [F.desc(score), *[F.asc(k) for k in key]], n).select(*key) for x in (a, b)]
    return best[0].intersect(best[1]).agg(F.count(F.lit(1)).alias(name))
