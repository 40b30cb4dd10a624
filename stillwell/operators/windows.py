"""Window operators. Every partition is one entity or cell at day grain, so the calendar bounds its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def previous_reading(readings: DataFrame, entity: str = "entity", date: str = "date",
                     columns: dict[str, str] | None = None) -> DataFrame:
    """Add the previous reading's columns, ``{column: new name}``; the first reading of an entity gets nulls."""
    order = W.partitionBy(entity).orderBy(date)
    columns = columns or {"value": "value_start", date: "prev_date", "season": "prev_season"}
    return readings.select("*", *[F.lag(c, 1).over(order).alias(n) for c, n in columns.items()])


def row_lags(df: DataFrame, value: str, lags: list[int], entity: str = "entity", date: str = "date") -> DataFrame:
    order = W.partitionBy(entity).orderBy(date)
    return df.select("*", *[F.lag(value, k).over(order).alias(f"{value}_lag{k}") for k in lags])


def prior_sums(df: DataFrame, value: str, sizes: list[int], entity: str = "entity", date: str = "date") -> DataFrame:
    """Sum of the ``k`` rows before each row, null unless all ``k`` exist and are known."""
    order = W.partitionBy(entity).orderBy(date)

    def total(k: int) -> Column:
        frame = order.rowsBetween(-k, -1)
        return F.when(F.count(value).over(frame) == k, F.sum(value).over(frame))

    return df.select("*", *[total(k).alias(f"{value}_prior{k}") for k in sizes])


def trailing_days(daily: DataFrame, value: str, spans: list[int], cell: str = "cell", date: str = "date") -> DataFrame:
    """Sum over the ``d`` days ending on each day, null where the window starts before the record."""
    day = F.unix_date(date)
    order = W.partitionBy(cell).orderBy(day)
    age = F.datediff(F.col(date), F.min(date).over(W.partitionBy(cell))) + 1

    def total(d: int) -> Column:
        return F.when(age >= d, F.sum(value).over(order.rangeBetween(-(d - 1), 0)))

    return daily.select("*", *[total(d).alias(f"{value}_{d}d") for d in spans])


def running_sum(daily: DataFrame, value: str, name: str, cell: str = "cell", date: str = "date") -> DataFrame:
    frame = W.partitionBy(cell).orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.withColumn(name, F.sum(value).over(frame))


def rolling_rows(df: DataFrame, value: str, sizes: list[int], cell: str = "cell", order: str = "month") -> DataFrame:
    """Sum of the last ``n`` rows including the current one, null until ``n`` known rows exist."""
    by = W.partitionBy(cell).orderBy(order)

    def total(n: int) -> Column:
        frame = by.rowsBetween(-(n - 1), 0)
        return F.when(F.count(value).over(frame) == n, F.sum(value).over(frame))

    return df.select("*", *[total(n).alias(f"{value}_{n}m") for n in sizes])


def z_score(df: DataFrame, value: str, keys: list[str], name: str, where: Column | None = None) -> DataFrame:
    """Distance from the group mean in sample standard deviations; null where the spread is zero.

    ``where`` limits which rows form the mean and spread (training years, to keep later rows out of it). The
    statistics are aggregated first and joined back, so a large group is never gathered.
    """
    used = F.col(value) if where is None else F.when(where, F.col(value))
    stats = df.groupBy(*keys).agg(F.avg(used).alias("_m"), F.stddev_samp(used).alias("_s"))
    return (df.join(stats, keys, "left")
            .withColumn(name, (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)))
            .drop("_m", "_s"))


def circular_mean(slots: DataFrame, value: str, name: str, width: int, period: int = 365, cell: str = "cell",
                  slot: str = "slot") -> DataFrame:
    """Centred moving mean of ``width`` slots on a ring of ``period`` slots."""
    half = width // 2
    padded = (slots.withColumn("_at", F.explode(F.array(F.col(slot) - period, F.col(slot), F.col(slot) + period)))
              .where(F.col("_at").between(-half, period - 1 + half)))
    frame = W.partitionBy(cell).orderBy("_at").rowsBetween(-half, half)
    return (padded.withColumn(name, F.avg(value).over(frame))
            .where(F.col("_at").between(0, period - 1)).drop("_at"))


def same_season_lag(df: DataFrame, value: str, name: str, entity: str = "entity", season: str = "season",
                    order: str = "date") -> DataFrame:
    """Value of the previous row of the same entity and season, whatever year that was."""
    return df.withColumn(name, F.lag(value, 1).over(W.partitionBy(entity, season).orderBy(order)))


def regular_step(number: Column, entity: str = "entity", date: str = "date") -> Column:
    """True where the previous reading was exactly one season earlier; ``number`` counts seasons."""
    return F.coalesce(number - F.lag(number, 1).over(W.partitionBy(entity).orderBy(date)) == 1, F.lit(False))


def last_reading(df: DataFrame, columns: list[str], entity: str = "entity", date: str = "date") -> DataFrame:
    return df.groupBy(entity).agg(F.max(date).alias("last_date"), *[F.max_by(c, date).alias(f"last_{c}")
                                                                    for c in columns])


def first_row(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Columns of the first row of each key; ties of ``order`` must not exist."""
    rank = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, rank).alias(c) for c in columns])


def path(df: DataFrame, step: str, name: str, keys: list[str], order: list[str]) -> DataFrame:
    """Running total of steps along a short chain (one forecast path, bounded by its number of steps)."""
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(step).over(frame))


def past_mean_and_last(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Mean of all earlier rows and the value of the row before: two naive predictors."""
    by = W.partitionBy(*keys).orderBy(order)
    return df.select("*", F.avg(value).over(by.rowsBetween(W.unboundedPreceding, -1)).alias("past_mean"),
                     F.lag(value, 1).over(by).alias("previous"))
