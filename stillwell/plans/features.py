"""The feature table: change since the previous reading and what the driver did before it.

The order of the steps matters. The previous reading is looked up first, unusable steps are dropped next, and
row lags and history sums then run over the surviving rows only. Normals come last, from training rows alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.constants import GAP_DAYS, HEAVY_MM, TRAILING_DAYS, WET_MM
from ..functions.numbers import ratio_at_least_one, ratio_or_null
from ..operators import cleaning, series, windows
from ..operators.joins import lookup_salted
from ..operators.spatial import with_place

#: Running totals of the driver at a place: whole parts, whose sums are exact, and what is left of them.
POINT_SUMS = ("cum", "cum_part")


def changes(readings: DataFrame, largest: float | None = None, gap: tuple[int, int] = GAP_DAYS) -> DataFrame:
    """Readings with a usable previous one: ``delta`` (positive = fell) and ``gap`` in days."""
    paired = windows.previous_reading(readings).where(F.col("value_start").isNotNull())
    paired = paired.select("*", (F.col("value") - F.col("value_start")).alias("delta"),
                           F.datediff("date", "prev_date").alias("gap"))
    return paired.where(cleaning.usable_step(F.col("gap"), F.col("delta"), gap, largest))


def pack_driver(daily: DataFrame, value: str = "mm") -> DataFrame:
    """Packed driver; a missing day counts as zero from here on."""
    mm = F.coalesce(F.col(value), F.lit(0.0))
    return with_peaks(series.pack(daily, {"mm": mm}, prefixes(mm)))


def pack_point_driver(daily: DataFrame, value: str = "mm") -> DataFrame:
    """Packed driver of each place from its daily values; a missing day counts as zero.

    Values between cells are no whole numbers, and a difference of two long running totals would lose digits. So whole
    parts and fractions have totals of their own.
    """
    mm = F.coalesce(F.col(value), F.lit(0.0))
    return with_peaks(series.pack(daily, {"mm": mm}, prefixes(mm) | {"cum": F.floor(mm), "cum_part": mm - F.floor(mm)}, cell="place"))


def with_peaks(packed: DataFrame, side: str = "") -> DataFrame:
    return packed.withColumn(f"peaks{side}", series.range_maxima(F.col(f"mm{side}")))


def prefixes(mm: Column) -> dict[str, Column]:
    """What a packed driver keeps running totals of."""
    return {"cum": mm, "cum_wet": (mm >= WET_MM).cast("int"), "cum_heavy": (mm >= HEAVY_MM).cast("int")}


def driver_features(date: Column, previous: Column, gap: Column, side: str = "",
                    sums: tuple[str, ...] = ("cum",)) -> dict[str, Callable[[], Column]]:
    """Driver features of one interval by name, to be selected where the packed driver is joined.

    ``side`` ends the names of the packed columns, where a row holds more than one driver. The running total of the
    driver is the sum of the columns ``sums``.
    """
    cum_wet, cum_heavy, peaks = (f"{c}{side}" for c in ("cum_wet", "cum_heavy", "peaks"))

    def over(span: Callable[..., Column], *at) -> Column:
        return reduce(add, [span(f"{c}{side}", *at) for c in sums])

    def total() -> Column:
        return over(series.span_sum, previous, date)

    def wet() -> Column:
        return series.span_sum(cum_wet, previous, date).cast("long")

    trailing = {f"mm_{d}d": partial(over, series.trailing_sum, date, d) for d in TRAILING_DAYS}
    return {
        "interval_mm": total, "interval_per_day": lambda: total() / gap, **trailing,
        "monsoon_mm": lambda: over(series.monsoon_sum, date), "wet_days": wet,
        "heavy_days": lambda: series.span_sum(cum_heavy, previous, date).cast("long"),
        "max_day_mm": lambda: series.span_max(peaks, previous, date),
        "per_wet_day": lambda: ratio_at_least_one(total(), wet()),
    }


def attach_driver(rows: DataFrame, packed: DataFrame, only: list[str] | None = None, cell: str = "cell",
                  salts: int = 1, sums: tuple[str, ...] = ("cum",)) -> DataFrame:
    """Driver features of each row from one equi-join on the cell; the arrays go no further."""
    features = driver_features(F.col("date"), F.col("prev_date"), F.col("gap"), sums=sums)
    joined = lookup_salted(rows, packed, [cell], salts, ["entity", "date"])
    return joined.select(*rows.columns, *[make().alias(n) for n, make in features.items() if only is None or n in only])


def attach_point_driver(rows: DataFrame, packed: DataFrame, salts: int = 1) -> DataFrame:
    """Driver features of each row from the driver at its own place; ``packed`` is from :func:`pack_point_driver`.

    The driver between the cells is worked out once a place and day, so a reading is a few array look-ups however long
    its windows are. ``packed`` grows with the places and the calendar, not with the readings.
    """
    placed = rows if "place" in rows.columns else with_place(rows)
    return attach_driver(placed, packed, cell="place", salts=salts, sums=POINT_SUMS)


def history(rows: DataFrame, value: str = "interval_mm") -> DataFrame:
    """Lags 1-3 and full sums of the 4, 8 and 12 rows before, in surviving readings."""
    return windows.prior_sums(windows.row_lags(rows, value, [1, 2, 3]), value, [4, 8, 12])


def with_normals(rows: DataFrame, train: Column) -> DataFrame:
    """Training-row means of each entity, and of each entity and season; null where it has no training row.

    The rows already sit together by entity for the lags, so these are windows over the same partitioning: no second
    pass over the rows and no join. An entity has at most one row per day.
    """
    entity, season = W.partitionBy("entity"), W.partitionBy("entity", "season")
    return rows.select(
        "*", F.avg(F.when(train, F.col("mm_365d"))).over(entity).alias("normal_annual_mm"),
        F.avg(F.when(train, F.col("monsoon_mm"))).over(entity).alias("normal_monsoon_mm"),
        F.avg(F.when(train, F.col("interval_mm"))).over(season).alias("normal_season_mm"))


def anomalies(rows: DataFrame, ratio_limit: float | None = None) -> DataFrame:
    """Differences from the normals and the season ratio, null for a zero normal, optionally limited."""
    ratio = ratio_or_null(F.col("interval_mm"), F.col("normal_season_mm"))
    if ratio_limit is not None:
        ratio = F.when(ratio > ratio_limit, F.lit(ratio_limit)).otherwise(ratio)
    return rows.withColumns({
        "anom_annual_mm": F.col("mm_365d") - F.col("normal_annual_mm"),
        "anom_season_mm": F.col("interval_mm") - F.col("normal_season_mm"),
        "anom_season_ratio": ratio,
        "anom_monsoon_mm": F.col("monsoon_mm") - F.col("normal_monsoon_mm")})


def feature_table(readings: DataFrame, entities: DataFrame, packed: DataFrame, train: tuple[int, int],
                  valid: tuple[int, int], test: tuple[int, int], largest: float | None = None,
                  attach: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Everything above in its order, with split labels and the season transition.

    ``attach`` joins rows and packed driver; without it each entity takes the series of its own cell.
    """
    rows = changes(readings, largest).join(entities, "entity")
    rows = history((attach or attach_driver)(rows, packed))
    year = F.col("season_year")
    rows = rows.where(cleaning.known_years(year, train, valid, test)).withColumn(
        "split", cleaning.year_split(year, train, valid))
    rows = with_normals(rows, F.col("split") == "train")
    return anomalies(rows).withColumn("transition", cleaning.transition(F.col("prev_season"), F.col("season")))
