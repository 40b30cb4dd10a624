"""Joins and look-ups between readings, entities and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_normals(df: DataFrame, normals: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left-join several tables of group normals, each on its own keys."""
    for table, keys in normals:
        df = df.join(table, keys, "left")
    return df


def star(fact: DataFrame, aggregate: DataFrame, aggregate_keys: list[str], dims: list[tuple[DataFrame, list[str]]],
         counts: list[str]) -> DataFrame:
    """Fact with an aggregate and dimensions attached; absent counts become 0."""
    out = fact.join(aggregate, aggregate_keys, "left").na.fill(0, counts)
    for dim, keys in dims:
        out = out.join(dim, keys, "left")
    return out


def only_in(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def days_of_intervals(intervals: DataFrame, daily: DataFrame, keys: list[str], cell: str = "cell",
                      date: str = "date", previous: str = "prev_date") -> DataFrame:
    """One row per interval and day in ``(previous, date]`` with the daily columns.

    The days of a cell and year are one row with a list, and an interval meets the years it touches: an equi-join on
    ``(cell, year)`` that moves a row per interval and year. The days come out of the lists after it, so what sums
    them up by interval does so before any row is moved. The interval length is limited by the gap filter upstream.
    """
    others = [c for c in daily.columns if c not in (cell, date)]
    lists = daily.groupBy(cell, F.year(date).alias("_year")).agg(
        F.collect_list(F.struct(F.col(date).alias("day"), *others)).alias("_days"))
    spans = intervals.select(*keys, cell, F.date_add(previous, 1).alias("_first"), F.col(date).alias("_last"))
    pieces = spans.where("_first <= _last").withColumn("_year", F.explode(F.sequence(F.year("_first"), F.year("_last"))))
    met = pieces.join(lists, [cell, "_year"])
    days = met.select(*keys, cell, "_first", "_last", F.inline("_days"))
    return days.where(F.col("day").between(F.col("_first"), F.col("_last"))).select(*keys, cell, "day", *others)


def lookup_salted(facts: DataFrame, dim: DataFrame, on: list[str], salts: int, spread_by: list[str]) -> DataFrame:
    """Inner look-up that splits every key into ``salts`` parts; ``dim`` is repeated that often.

    For a dimension with wide rows and few keys (packed series), where one key may own a third of the facts. With
    one salt it is the plain join, which Spark splits by itself when it meets a skewed key.
    """
    if salts == 1:
        return facts.join(dim, on)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "_salt"]).drop("_salt")


def combine_measures(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left")
