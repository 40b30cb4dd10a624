"""Weekly channels behind a reading: 104 weeks ending on the reading day, oldest first.

Weeks of one reading are seven days apart, so all weeks of a cell that end on the same weekday form one array and
the sequence of a reading is a slice of it. Seven arrays per cell serve every reading, and readings meet them in one
equi-join on ``(cell, weekday)``, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import dates
from ..functions.constants import SEQUENCE_WEEKS, SMOOTH_DAYS, WET_MM
from ..functions.numbers import year_angle
from ..operators import aggregates, windows
from ..operators.joins import lookup_salted

# channels that belong to the cell and the week; in_interval belongs to the reading
CELL_CHANNELS = ["rain_mm", "doy_sin", "doy_cos", "rain_anom_mm", "wet_frac"]


def smoothed_normals(daily: DataFrame, train: Column, value: str = "mm", width: int = SMOOTH_DAYS) -> DataFrame:
    """Normal per cell and day-of-year slot, smoothed over ``width`` slots around the year."""
    slots = aggregates.slot_means(daily, value, train)
    return windows.circular_mean(slots, "normal", "smooth", width).select("cell", "slot", "normal", "smooth")


def weekday(date: Column) -> Column:
    return F.pmod(F.unix_date(date), F.lit(7))


def pack_weeks(daily: DataFrame, normals: DataFrame, value: str = "mm") -> DataFrame:
    """Per cell and weekday: the day the first whole week ends on and the channels of every week, oldest first.

    ``daily`` must be dense. An array is as long as the record has weeks.
    """
    mm = F.coalesce(F.col(value), F.lit(0.0))
    with_slot = daily.select("cell", "date", mm.alias("_mm"), dates.day_slot(F.col("date")).alias("slot"))
    joined = with_slot.join(normals.select("cell", "slot", "smooth"), ["cell", "slot"], "left")
    week = W.partitionBy("cell").orderBy("date").rowsBetween(-6, 0)
    angle = year_angle(F.dayofyear(F.date_sub("date", 3)))
    weeks = joined.select(
        "cell", "date", F.count(F.lit(1)).over(week).alias("_n"), F.sum("_mm").over(week).alias("rain_mm"),
        F.sin(angle).alias("doy_sin"), F.cos(angle).alias("doy_cos"),
        F.sum(F.col("_mm") - F.col("smooth")).over(week).alias("rain_anom_mm"),
        (F.sum((F.col("_mm") >= WET_MM).cast("int")).over(week) / F.lit(7.0)).alias("wet_frac")).where("_n = 7")
    packed = weeks.groupBy("cell", weekday(F.col("date")).alias("weekday")).agg(
        F.min("date").alias("first_week"), F.array_sort(F.collect_list(F.struct("date", *CELL_CHANNELS))).alias("_w"))
    return packed.select("cell", "weekday", "first_week", F.transform(
        "_w", lambda w: F.struct(*[w[c].alias(c) for c in CELL_CHANNELS])).alias("cell_weeks"))


def attach_cell_weeks(rows: DataFrame, packed: DataFrame, weeks: int = SEQUENCE_WEEKS, cell: str = "cell",
                      salts: int = 1) -> DataFrame:
    """The cell's channels of the ``weeks`` weeks ending on each reading day; null unless the record covers them all."""
    joined = lookup_salted(rows.withColumn("weekday", weekday(F.col("date"))), packed, [cell, "weekday"], salts,
                           ["entity", "date"])
    first = F.floor(F.datediff("date", "first_week") / 7).cast("int") - (weeks - 1)
    covered = (first >= 0) & (first + weeks <= F.size("cell_weeks"))
    return joined.select(*rows.columns, F.when(
        covered, F.slice("cell_weeks", F.greatest(first, F.lit(0)) + 1, F.lit(weeks))).alias("weeks"))


def interval_share(gap: Column, week: Column, weeks: int = SEQUENCE_WEEKS) -> Column:
    """Share of a week's days after the previous reading, ``gap`` days before the end of the last week."""
    return F.greatest(F.lit(0), F.least(gap - (F.lit(weeks - 1) - week) * 7, F.lit(7))) / F.lit(7.0)


def week_rows(with_cell: DataFrame, keep: list[str], weeks: int = SEQUENCE_WEEKS) -> DataFrame:
    """Long form: one row per reading and week with the columns of ``keep``, ``week`` from 0 and all six channels.

    ``with_cell`` comes from :func:`attach_cell_weeks`; readings it does not cover give no rows. Everything here is
    compiled into the stage of the join, so this is the form to aggregate from.
    """
    long = with_cell.select(*keep, "gap", F.posexplode("weeks").alias("week", "_w"))
    return long.select(*keep, "week", F.col("_w.rain_mm").alias("rain_mm"),
                       interval_share(F.col("gap"), F.col("week"), weeks).alias("in_interval"),
                       *[F.col(f"_w.{c}").alias(c) for c in CELL_CHANNELS[1:]])


def attach_weeks(with_cell: DataFrame, weeks: int = SEQUENCE_WEEKS) -> DataFrame:
    """Stored form: all six channels of a reading as one array of structs."""
    return with_cell.withColumn("weeks", F.transform("weeks", lambda w, i: F.struct(
        w["rain_mm"].alias("rain_mm"), interval_share(F.col("gap"), i, weeks).alias("in_interval"),
        *[w[c].alias(c) for c in CELL_CHANNELS[1:]])))


def interval_mismatch(rows: DataFrame, weeks: int = SEQUENCE_WEEKS) -> DataFrame:
    """Largest difference between the days the channels place inside the interval and its length; must be 0."""
    covered = rows.where(F.col("weeks").isNotNull() & (F.col("gap") <= weeks * 7))
    days = F.aggregate("weeks.in_interval", F.lit(0.0), lambda a, v: a + v) * 7
    return covered.agg(F.max(F.abs(days - F.col("gap"))).alias("largest"), F.count(F.lit(1)).alias("rows"))


def scale_rain(week_rows: DataFrame, factor: Column | float) -> DataFrame:
    """The driver of every week times ``factor``; the anomaly moves along, the other channels stay."""
    f = F.lit(factor) if isinstance(factor, (int, float)) else factor
    rain = F.greatest(F.col("rain_mm"), F.lit(0.0))
    return week_rows.withColumns({"rain_mm": rain * f, "rain_anom_mm": F.col("rain_anom_mm") + (f - 1) * rain})
