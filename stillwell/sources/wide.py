"""Wide reading files: one row per station, one column per campaign ``Mon-YY``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.constants import DEPTH_LIMITS, MIN_READINGS, READING_DAY, SEASON_MONTH
from ..functions.strings import tidy_category
from ..operators import cleaning

CAMPAIGN = re.compile("^(" + "|".join(s.title() for s in SEASON_MONTH) + ")-")

# File headings and the names used from here on.
STATION_COLUMNS = {
    "Station Name": "station", "State": "state", "District": "district", "Latitude": "lat", "Longitude": "lon",
    "Type of Well": "well_type", "Aquifer Type": "aquifer", "Well Depth": "well_depth_m", "Reference_Sy": "sy",
}


def read_wide(spark: SparkSession, path: str, row: str = "file_row") -> DataFrame:
    """CSV with trimmed headings and row numbers from 0 in file order, files in order of their paths.

    Tasks take files by size, not by name, so ids of tasks say nothing across files. A block of a file is read by one
    task in order: its rows count on from the rows of all blocks before it. The running count has one row per block.
    """
    raw = spark.read.csv(path, header=True)
    names = [c.strip() for c in raw.columns]
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    placed = placed.toDF(*names, "_file", "_block").withColumn("_id", F.monotonically_increasing_id())
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = placed.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    blocks = blocks.select("_file", "_block", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(blocks, ["_file", "_block"]).select(*[F.col(f"`{c}`") for c in names], (F.col("_id") + F.col("_shift")).alias(row))


def campaign_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if CAMPAIGN.match(c)]


def to_long(df: DataFrame, keys: list[str], campaigns: list[str], value: str = "depth_mbgl") -> DataFrame:
    """One row per station and campaign that has a number."""
    numbers = df.select(*keys, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in campaigns])
    return numbers.unpivot(keys, campaigns, "campaign", value).where(F.col(value).isNotNull())


def campaign_year(label: Column, pivot: int | None = 50) -> Column:
    """Year of a label ``Mon-YY``: below ``pivot`` is this century, else the last; always this one if None."""
    yy = F.substring(label, 5, 2).cast("int")
    return yy + 2000 if pivot is None else F.when(yy < pivot, yy + 2000).otherwise(yy + 1900)


def parse_campaign(df: DataFrame, label: str = "campaign", day: int = READING_DAY, pivot: int | None = 50) -> DataFrame:
    """Add ``campaign_date``, ``season`` and ``season_year``."""
    season = F.upper(F.substring(label, 1, 3))
    months = F.create_map(*[F.lit(x) for pair in SEASON_MONTH.items() for x in pair])
    year = campaign_year(F.col(label), pivot)
    return df.select("*", F.make_date(year, F.element_at(months, season), F.lit(day)).alias("campaign_date"),
                     season.alias("season"), year.alias("season_year"))


def load_readings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cleaned long readings and the station table of a wide file."""
    raw = read_wide(spark, path)
    campaigns = campaign_columns(raw)
    number = {"lat", "lon", "well_depth_m", "sy"}
    meta = raw.select("file_row", *[
        (F.expr(f"try_cast(`{c}` as double)") if n in number else F.col(f"`{c}`")).alias(n)
        for c, n in STATION_COLUMNS.items()], *[F.col(f"`{c}`") for c in campaigns])
    meta = cleaning.coordinate_key(meta, "lat", "lon", "file_row")
    long = parse_campaign(to_long(meta, ["well_uid"], campaigns)).drop("campaign")
    stations = meta.select("well_uid", *STATION_COLUMNS.values())
    stations = stations.withColumns({c: tidy_category(F.col(c)) for c in ("aquifer", "well_type")})
    readings = cleaning.between_open(long.join(stations.drop("station"), "well_uid", "left"),
                                     "depth_mbgl", *DEPTH_LIMITS)
    return cleaning.enough_readings(readings, "well_uid", MIN_READINGS), stations
