"""Keys, filters, labels and gap filling."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.constants import (AQUIFER_SOURCES, BLANK_TOKENS, DUG_TYPES, FORBIDDEN, CATEGORICAL, GAP_DAYS, MIN_READINGS,
                                   ROCK_CLASS, TRAIN_YEARS, VALID_YEARS, TEST_YEARS)
from ..functions.strings import blank_to_null
from .ranking import segmented_row_number


def coordinate_key(df: DataFrame, lat: str, lon: str, row: str, name: str = "well_uid", digits: int = 4) -> DataFrame:
    """Key from rounded coordinates; every member of a repeated key gets ``_0, _1, ...`` in row order."""
    keyed = df.withColumn("_key", F.concat_ws("_", F.round(lat, digits).cast("string"),
                                              F.round(lon, digits).cast("string")))
    numbered = segmented_row_number(keyed, ["_key"], row, "_nth")
    return numbered.withColumn(name, F.when(
        F.col("_nth_of") > 1, F.concat_ws("_", "_key", F.col("_nth").cast("string"))).otherwise(F.col("_key"))).drop(
        "_key", "_nth", "_nth_of")


def between_open(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(value) > low) & (F.col(value) < high))


def enough_readings(df: DataFrame, entity: str = "entity", at_least: int = MIN_READINGS) -> DataFrame:
    """Rows of entities with enough rows; counts combine before the shuffle."""
    keep = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).select(entity)
    return df.join(keep, entity, "left_semi")


def usable_step(gap: Column, step: Column, days: tuple[int, int] = GAP_DAYS, largest: float | None = None) -> Column:
    """Condition for a change between two readings to be kept; all limits are inclusive."""
    ok = gap.between(*days)
    return ok if largest is None else ok & (F.abs(step) <= largest)


def year_split(year: Column, train: tuple[int, int] = TRAIN_YEARS, valid: tuple[int, int] = VALID_YEARS) -> Column:
    return F.when(year.between(*train), "train").when(year.between(*valid), "valid").otherwise("test")


def known_years(year: Column, train: tuple[int, int] = TRAIN_YEARS, valid: tuple[int, int] = VALID_YEARS,
                test: tuple[int, int] = TEST_YEARS) -> Column:
    return year.between(*train) | year.between(*valid) | year.between(*test)


def transition(previous: Column, current: Column) -> Column:
    """``PREVIOUS_CURRENT``; null if either is."""
    return F.concat(previous, F.lit("_"), current)


def feature_spec(df: DataFrame, target: str, forbidden: list[str] | None = None,
                 categorical: list[str] | None = None) -> DataFrame:
    """Role and kind of every column."""
    forbidden, categorical = forbidden or FORBIDDEN, categorical or CATEGORICAL
    rows = [(c, "target" if c == target else "meta" if c in forbidden else "feature",
             "categorical" if c in categorical else "numeric") for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, role string, kind string")


def assert_no_leakage(features: list[str], target: str, forbidden: list[str] | None = None) -> None:
    leaked = sorted(set(features) & ({target} | set(forbidden or FORBIDDEN)))
    if leaked:
        raise ValueError(f"columns that may not be features: {leaked}")


def fill_aquifer(df: DataFrame, aquifer: str = "aquifer", well_type: str = "well_type") -> DataFrame:
    """Blank types become null; a blank aquifer of a dug well is unconfined; what is left is ``Unknown``."""
    a, t = blank_to_null(F.col(aquifer), BLANK_TOKENS), blank_to_null(F.col(well_type), BLANK_TOKENS)
    dug = a.isNull() & F.coalesce(t.isin(DUG_TYPES), F.lit(False))
    return df.select(
        *[c for c in df.columns if c not in (aquifer, well_type)],
        F.when(dug, "Unconfined").otherwise(F.coalesce(a, F.lit("Unknown"))).alias(aquifer),
        F.when(a.isNotNull(), AQUIFER_SOURCES["recorded"]).when(dug, AQUIFER_SOURCES["inferred"])
        .otherwise(AQUIFER_SOURCES["neither"]).alias("aquifer_source"),
        F.coalesce(t, F.lit("Unknown")).alias(well_type))


def first_known(choices: list[tuple[str, Column]], otherwise: tuple[Column, Column]) -> tuple[Column, Column]:
    """Value and source label of the first choice that is not null, else ``otherwise = (value, label)``."""
    value = F.coalesce(*[c for _, c in choices], otherwise[0])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(label)) for label, c in choices], otherwise[1])
    return value, source


def rock_class(sy: Column) -> Column:
    classes = F.create_map(*[F.lit(x) for x in chain(*((f"{k:.3f}", v) for k, v in ROCK_CLASS.items()))])
    return F.try_element_at(classes, F.format_string("%.3f", sy))


def keep_originals(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Copy ``{column: copy}`` once; a second run leaves the copies alone."""
    return df.select("*", *[F.col(c).alias(k) for c, k in columns.items() if k not in df.columns])


def exact_subsample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, the same for the same seed: those with the smallest hashes of their key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string"))), key).limit(n)


def grouped_filter(df: DataFrame, keys: list[str], distinct: str, at_least: int) -> DataFrame:
    """Rows of groups with at least ``at_least`` distinct values."""
    keep = (df.groupBy(*keys).agg(F.countDistinct(distinct).alias("_n"))
            .where(F.col("_n") >= at_least).select(*keys))
    return df.join(keep, keys, "left_semi")


def dense_index(df: DataFrame, order: str, columns: list[str], name: str) -> DataFrame:
    """Distinct rows numbered from 0 by date; for calendars, whose length the calendar bounds."""
    return df.select(order, *columns).distinct().withColumn(
        name, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)) - 1)
