"""Gridded daily driver: land mask, packing, per-year export."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import quantise, tenths


def land_cells(grid: DataFrame, value: str = "mm", keys: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Cells that ever report a finite value."""
    known = F.col(value).isNotNull() & ~F.isnan(value)
    return grid.groupBy(*keys).agg(F.max(known).alias("_land")).where("_land").select(*keys)


def pack_grid(grid: DataFrame, value: str = "mm", keys: tuple[str, ...] = ("lat", "lon"),
              date: str = "date") -> DataFrame:
    """Land cells only, tenths as ``smallint`` with real nulls."""
    land = land_cells(grid, value, keys)
    return grid.join(land, list(keys), "left_semi").select(*keys, date, tenths(F.col(value)).alias(f"{value}10"))


def unpack(df: DataFrame, packed: str = "mm10", value: str = "mm", sentinel: int | None = None) -> DataFrame:
    """Amounts in millimetres; an old file's sentinel becomes null."""
    v = F.col(packed) if sentinel is None else F.nullif(F.col(packed), F.lit(sentinel))
    return df.withColumn(value, v / 10.0).drop(packed)


def quantised(daily: DataFrame, value: str = "mm", date: str = "date") -> DataFrame:
    """One-byte log code per cell and day with its year, missing days as dry."""
    return daily.select("*", F.year(date).alias("year"), quantise(F.col(value)).alias("code")).drop(value)


def export_by_year(daily: DataFrame, path: str, value: str = "mm", date: str = "date", cell: str = "cell") -> None:
    """Codes in one folder per year, days in order inside each file."""
    coded = quantised(daily, value, date)
    coded.repartition("year", F.month(date)).sortWithinPartitions("year", date, cell).write.mode(
        "overwrite").partitionBy("year").parquet(path)


def national_mean(daily: DataFrame, value: str = "mm", date: str = "date") -> DataFrame:
    """Mean over the cells that have data on a day (missing cells are left out), two digits."""
    return daily.groupBy(date).agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), 2).alias("mean_mm"))
