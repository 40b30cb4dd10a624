"""Writers for the tables the jobs hand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None, sort: list[str] | None = None) -> None:
    """Parquet, optionally in folders by column and sorted inside each file."""
    if sort:
        df = df.sortWithinPartitions(*(by or []), *sort)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def history_documents(rows: DataFrame, entity: str, facts: list[str], order: str, history: dict[str, Column]) -> DataFrame:
    """One document per entity with its readings as an ordered nested list ``h``.

    Readings are unique per entity and day, so a list is at most as long as the calendar.
    """
    item = F.struct(F.col(order).alias("_o"), F.struct(*[c.alias(n) for n, c in history.items()]).alias("h"))
    first = [F.min_by(c, order).alias(c) for c in facts]
    docs = rows.groupBy(entity).agg(*first, F.array_sort(F.collect_list(item)).alias("_h"))
    return docs.select(entity, *facts, F.transform("_h", lambda x: x["h"]).alias("h"))


def yearly_map(cube: DataFrame, keys: list[str], year: str, values: list[str]) -> DataFrame:
    """Nested export form of a yearly cube: one row per group with ``year -> values``."""
    entry = F.struct(F.col(year).cast("int").alias("key"), F.array(*values).alias("value"))
    return cube.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("years"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)
