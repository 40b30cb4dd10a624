"""Grouped statistics. Sums, counts and moments combine on the map side before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import dates, numbers
from ..functions.constants import HEAVY_DAY_MM, WET_MM
from ..functions.numbers import clip


def summary(df: DataFrame, keys: list[str], value: str, entity: str = "entity") -> DataFrame:
    """Mean, count, size, distinct entities and sample standard deviation per group."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.count(value).alias("known"), F.count(F.lit(1)).alias("rows"),
        F.countDistinct(entity).alias("entities"), F.stddev_samp(value).alias("std"))


def train_mean(df: DataFrame, keys: list[str], value: str, name: str, train: Column) -> DataFrame:
    """Normal per group from training rows only; a group without any is absent."""
    return df.where(train).groupBy(*keys).agg(F.avg(value).alias(name))


def monthly(daily: DataFrame, value: str, wet: Column, keys: list[str], date: str = "date") -> DataFrame:
    return daily.groupBy(*keys, F.trunc(date, "month").alias("month")).agg(
        F.sum(value).alias(value), F.count_if(wet).alias("wet_days"))


def sum_if_complete(value: str, needed: int) -> Column:
    return F.when(F.count(value) >= needed, F.sum(value))


def percent_missing(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.avg(F.col(value).isNull().cast("double")) * 100).alias("missing_pct"),
                                 F.count(F.lit(1)).alias("rows"))


def share_of_total(df: DataFrame, value: str, part: Column, name: str) -> DataFrame:
    return df.agg((F.sum(F.when(part, F.col(value))) / F.nullif(F.sum(value), F.lit(0.0))).alias(name))


def slope(df: DataFrame, keys: list[str], x: str, y: str, name: str, at_least: int, distinct: bool = False,
          otherwise: float | None = None) -> DataFrame:
    """Least-squares slope per group with enough points (or enough distinct ``x``)."""
    n = F.countDistinct(x) if distinct else F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return df.groupBy(*keys).agg(n.alias("points"), F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double"))
                                 .alias("_s")).select(
        *keys, "points", F.when(F.col("points") >= at_least, F.col("_s")).otherwise(F.lit(otherwise)).alias(name))


def correlation(df: DataFrame, keys: list[str], x: str, y: str, more_than: int = 0) -> DataFrame:
    both = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return (df.groupBy(*keys).agg(numbers.correlation(F.col(x), F.col(y)).alias("corr"), both.alias("rows"))
            .where(F.col("rows") > more_than))


def lag1_autocorrelation(df: DataFrame, keys: list[str], value: str, order: str, exactly: int) -> DataFrame:
    """Correlation of a yearly series with itself one row earlier, for groups of exactly ``exactly`` rows."""
    by = W.partitionBy(*keys)
    pairs = df.select(*keys, value, F.lag(value, 1).over(by.orderBy(order)).alias("_before"),
                      F.count(F.lit(1)).over(by).alias("_n"))
    return pairs.where(F.col("_n") == exactly).groupBy(*keys).agg(numbers.correlation(F.col(value), F.col("_before")).alias("autocorr"))


def error_metrics(df: DataFrame, keys: list[str], observed: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R2 (null for a constant target) and bias of predictions."""
    e = F.col(predicted) - F.col(observed)
    spread = F.var_pop(observed)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(spread > 0, 1 - F.avg(e * e) / spread).alias("r2"), F.avg(e).alias("bias"))


def skewness(df: DataFrame, value: str, name: str) -> DataFrame:
    """Bias-corrected sample skewness."""
    n = F.count(value).cast("double")
    return df.agg((F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)).alias(name))


def crosstab_margins(df: DataFrame, row: str, column: str, values: list[str], total: str = "total") -> DataFrame:
    """Counts of ``row`` by the listed ``column`` values with a total row and a total column."""
    counts = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = [F.count_if(F.col(column) == v).alias(v) for v in values]
    table = counts.rollup(row).agg(*cells, F.count(F.lit(1)).alias(total), F.grouping(row).alias("_all"))
    return table.select(F.when(F.col("_all") == 1, total).otherwise(F.col(row)).alias(row), *values, total)


def value_counts(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Counts of each value before and after a change; values of one side only show 0 on the other."""
    a, b = (x.groupBy(column).agg(F.count(F.lit(1)).alias(n)) for x, n in ((before, "before"), (after, "after")))
    return a.join(b, column, "full").na.fill(0, ["before", "after"])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin after clipping; the top edge belongs to the last bin."""
    clipped = clip(F.col(value), low, high)
    number = F.least(F.width_bucket(clipped, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def time_bins(df: DataFrame, place: str, value: str, n: int, bins: int) -> DataFrame:
    """Mean of a series of ``n`` points in ``bins`` equal parts.

    Bin ``x`` covers the points from ``floor(x/bins*n)`` up to the next bin's start, at least one.
    """
    first = F.ceil((F.col(place) + 1) * bins / F.lit(n)).cast("int") - 1
    if bins <= n:
        return (df.withColumn("bin", first).groupBy("bin").agg(F.avg(value).alias(value)))
    spread = F.sequence(F.ceil(F.col(place) * bins / F.lit(n)).cast("int"), first)
    return df.withColumn("bin", F.explode(spread)).groupBy("bin").agg(F.avg(value).alias(value))


def array_means(df: DataFrame, array: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of every array position over the rows of a group."""
    keys = keys or []
    return (df.select(*keys, F.posexplode(array).alias("pos", "_v"))
            .groupBy(*keys, "pos").agg(F.avg("_v").alias("mean"), F.count("_v").alias("rows")))


def rise_fall(df: DataFrame, keys: list[str], change: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(change).alias("known"), F.count_if(F.col(change) > 0).alias("fell"),
                                 F.count_if(F.col(change) <= 0).alias("rose"))


def day_summary(daily: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Grid summary per day; a missing cell counts as dry."""
    mm = F.coalesce(F.col(value), F.lit(0.0))
    return daily.groupBy(*keys).agg(
        F.avg(mm).alias("mean_mm"), F.max(mm).alias("max_mm"), F.count_if(mm >= HEAVY_DAY_MM).alias("heavy_cells"),
        F.count_if(mm >= WET_MM).alias("cells_with_rain"))


def weighted_centre(boxes: DataFrame, key: str) -> DataFrame:
    """Area-weighted centre of the boxes of each group."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes.groupBy(key).agg(
        (F.sum((F.col("x0") + F.col("x1")) / 2 * area) / F.nullif(F.sum(area), F.lit(0.0))).alias("x"),
        (F.sum((F.col("y0") + F.col("y1")) / 2 * area) / F.nullif(F.sum(area), F.lit(0.0))).alias("y"), F.sum(area).alias("area"))


def mean_within_std(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """How much each column varies inside an entity: mean, median and maximum of the per-entity spread.

    The median is the built-in percentile, which counts equal values before it ranks them.
    """
    spread = df.groupBy(entity).agg(*[F.stddev_samp(c).alias(c) for c in columns])
    long = spread.unpivot([entity], columns, "feature", "std")
    return long.groupBy("feature").agg(F.avg("std").alias("mean_std"), F.median("std").alias("median_std"), F.max("std").alias("max_std"),
                                       F.count("std").alias("entities"))


def calendar_means(monthly_table: DataFrame, value: str, month: str = "month") -> tuple[DataFrame, DataFrame]:
    """Mean per calendar month, and mean monthly amount per year times twelve."""
    by_month = monthly_table.groupBy(F.month(month).alias("cal_month")).agg(F.avg(value).alias("mean"))
    by_year = monthly_table.groupBy(F.year(month).alias("year")).agg((F.avg(value) * 12).alias("annual"))
    return by_month, by_year


def slot_means(daily: DataFrame, value: str, train: Column, cell: str = "cell", date: str = "date") -> DataFrame:
    """Mean per cell and day-of-year slot over training days, missing days as zero."""
    return (daily.where(train).groupBy(cell, dates.day_slot(F.col(date)).alias("slot"))
            .agg(F.avg(F.coalesce(F.col(value), F.lit(0.0))).alias("normal")))


def pivot(df: DataFrame, keys: list[str], column: str, values: list, value: str) -> DataFrame:
    """Wide form of a long table, for a known list of column values."""
    return df.groupBy(*keys).pivot(column, values).agg(F.first(value))
