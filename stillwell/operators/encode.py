"""Scaling and encoding with statistics of the training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import signed_log
from ..session import kept
from .ranking import exact_percentiles, range_count, with_range

LOG_CHANNEL, SIGNED_LOG_CHANNEL = "rain_mm", "rain_anom_mm"


def squash(channel: str, v: Column) -> Column:
    if channel == LOG_CHANNEL:
        return F.log1p(F.when(v < 0, F.lit(0.0)).otherwise(v))
    return signed_log(v) if channel == SIGNED_LOG_CHANNEL else v


def channel_stats(week_rows: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the squashed rain channels over all weeks: one row."""
    parts = []
    for c in (LOG_CHANNEL, SIGNED_LOG_CHANNEL):
        v = squash(c, F.col(c))
        parts += [F.avg(v).alias(f"{c}_mean"), F.greatest(F.stddev_pop(v), F.lit(1e-6)).alias(f"{c}_std")]
    return week_rows.agg(*parts)


def scale_channels(week_rows: DataFrame, stats: dict[str, float], channels: list[str]) -> DataFrame:
    """Scaled channels: squashed and standardised rain, the others as they are, non-finite values 0.

    ``stats`` is the row of :func:`channel_stats` as a dict, from this or an earlier run.
    """
    def one(c: str) -> Column:
        v = squash(c, F.col(c))
        if c in (LOG_CHANNEL, SIGNED_LOG_CHANNEL):
            v = (v - F.lit(stats[f"{c}_mean"])) / F.lit(stats[f"{c}_std"])
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.lit(0.0))

    return week_rows.withColumns({c: one(c) for c in channels})


def numeric_stats(rows: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Median, and mean and population spread after filling with it, per column: ``feature, median, mean, std``."""
    seen = rows.where(train).select(*columns)
    long = seen.unpivot([], columns, "feature", "v")
    medians = exact_percentiles(long, ["feature"], "v", {"median": 0.5})
    filled = long.join(F.broadcast(medians), "feature")         # one row per column
    v = F.coalesce("v", "median")
    return filled.groupBy("feature").agg(F.first("median").alias("median"), F.avg(v).alias("mean"),
                                         F.stddev_pop(v).alias("_sd")).select(
        "feature", "median", "mean", F.when(F.col("_sd") < 1e-6, F.lit(1.0)).otherwise(F.col("_sd")).alias("std"))


def encode_numeric(rows: DataFrame, columns: list[str], stats: dict[str, dict[str, float]]) -> DataFrame:
    """Fill with the median and standardise. ``stats[column]`` has ``median``, ``mean`` and ``std``."""
    return rows.select(*[c for c in rows.columns if c not in columns], *[
        ((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(stats[c]["median"]))
          - F.lit(stats[c]["mean"])) / F.lit(stats[c]["std"])).alias(c) for c in columns])


def saved(stats: DataFrame, key: str = "feature") -> dict[str, dict[str, float]]:
    """Fitted statistics as plain numbers, one entry per column, to keep with a model and apply to new data."""
    return {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in stats.collect()}


def category_levels(rows: DataFrame, column: str, train: Column, ranges: int | None = None) -> DataFrame:
    """Sorted training levels with an index from 0: the vocabulary of a category, one row per level.

    Levels are numbered inside ranges and moved up by the sizes of the ranges before, so no task holds them all.
    Split points come from the levels with the smallest md5, a few per range; any would give the same numbers.
    """
    levels = kept(rows.where(train).select(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).distinct())
    ranges = range_count(levels, ranges)
    some = levels.orderBy(F.md5(column), column).limit(16 * ranges).agg(F.array_sort(F.collect_list(column)).alias("l"))
    places = F.sequence(F.lit(1), F.lit(max(ranges - 1, 1)))
    splits = some.select(F.transform(places, lambda i: F.get("l", F.floor(i * F.size("l") / F.lit(ranges)).cast("int")))).scalar()
    cut = with_range(levels, column, splits if ranges > 1 else None, ranges)
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))             # one row per range
    line = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(column)) - 1
    return cut.withColumn("_inside", inside).join(F.broadcast(starts), "_range").select(
        column, (F.col("_start") + F.col("_inside")).cast("int").alias("code"))


def encode_category(rows: DataFrame, column: str, levels: DataFrame, name: str) -> DataFrame:
    """Index of the level; levels that training rows never showed share one bucket after the last."""
    size = levels.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    looked_up = levels.withColumnsRenamed({column: "_level", "code": "_code"})
    return (rows.withColumn("_level", F.coalesce(F.col(column), F.lit("unknown")))
            .join(looked_up, "_level", "left")
            .withColumn(name, F.coalesce("_code", size)).drop("_level", "_code"))
