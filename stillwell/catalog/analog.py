"""The given tables read as stations and a driver.

An entity is a customer, a reading one of its orders, a group its nation and a state its region. The driver is the
quantity shipped per supplier nation and day; nations are the cells of a 5 x 5 lattice (row ``key div 5``, column
``key % 5``). Years 1995-98 train, 1999 validates, 2000 and later test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates
from ..operators import cleaning, series
from ..plans import expected, features

#: Every later year tests.
TRAIN, VALID, TEST = (1995, 1998), (1999, 1999), (2000, 9999)
HELD_OUT = (1999, 2001)
FIRST_DAY, LAST_DAY = "1995-01-01", "2001-12-31"
FIRST_YEAR, LAST_YEAR = 1995, 2001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-grain readings. A customer has at most one row per day from here on, so the calendar bounds its rows."""
    daily = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.max_by("o_totalprice", "o_orderkey") / 1000).alias("value"))
    return daily.select("*", dates.season_of_quarter(F.col("date")).alias("season"), F.year("date").alias("season_year"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("cell"), F.col("n_name").alias("grp"), F.col("r_name").alias("state"))
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("cell"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), (F.col("c_custkey") * 37 % 401 / 100.0).alias("lat"),
        (F.col("c_custkey") * 73 % 401 / 100.0).alias("lon"))
    return customer.join(place, "cell")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("cell"), F.floor(key / 5).cast("int").alias("row"), (key % 5).cast("int").alias("col"))


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver as recorded: only the days a nation shipped on."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("s_nationkey").alias("cell"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").alias("mm"))


def calendar_ends(known: DataFrame) -> tuple:
    """First and last day of the years that a record touches, found while the query runs."""
    return (known.agg(F.trunc(F.min("date"), "year").alias("d")).scalar(),
            known.agg(F.date_sub(F.add_months(F.trunc(F.max("date"), "year"), 12), 1).alias("d")).scalar())


def driver(spark: SparkSession, sf_dir: str, fill: float | None = 0.0) -> DataFrame:
    """Every day of the years that the record touches."""
    known = shipped(spark, sf_dir)
    first, last = calendar_ends(known)
    return series.dense_calendar(known, cells(spark, sf_dir), first, last, "mm", fill)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pack_driver(driver(spark, sf_dir))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable changes with the entity's facts and the split label."""
    rows = features.changes(readings(spark, sf_dir)).withColumn(
        "split", cleaning.year_split(F.col("season_year"), TRAIN, VALID))
    return rows.join(entities(spark, sf_dir), "entity")


def with_driver(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return features.attach_driver(intervals(spark, sf_dir), packed(spark, sf_dir), list(only) or None)


def is_train():
    return F.col("split") == "train"


def lines(rows: DataFrame) -> DataFrame:
    """The fitted lines: one row per season of the year."""
    return expected.season_line(rows, is_train())


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with their expectation from the interval driver and the residual."""
    rows = with_driver(spark, sf_dir, "interval_mm")
    return expected.residuals(expected.apply_line(rows, lines(rows)))


# ---- the same tables in SQL, each a common table expression and the ones it needs
_CTES = {
    "readings": ((), """SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS date,
        arg_max(o_totalprice, o_orderkey) / 1000 AS value,
        ['JAN','MAY','AUG','NOV'][quarter(CAST(o_orderdate AS DATE))] AS season,
        CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS season_year
        FROM orders GROUP BY entity, date, season, season_year"""),
    "entities": ((), """SELECT c_custkey AS entity, c_nationkey AS cell, c_mktsegment AS segment, c_acctbal AS balance,
        CAST(c_custkey * 37 % 401 AS DOUBLE) / 100 AS lat, CAST(c_custkey * 73 % 401 AS DOUBLE) / 100 AS lon,
        n_name AS grp, r_name AS state
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "cells": ((), "SELECT n_nationkey AS cell, n_nationkey // 5 AS row, n_nationkey % 5 AS col FROM nation"),
    "shipped": ((), """SELECT s_nationkey AS cell, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS mm
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""),
    "calendar": (("shipped",), """SELECT CAST(unnest(generate_series(date_trunc('year', (SELECT min(date) FROM shipped)),
        date_trunc('year', (SELECT max(date) FROM shipped)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date"""),
    "sparse_driver": (("shipped", "calendar"), """SELECT n_nationkey AS cell, c.date, s.mm
        FROM nation CROSS JOIN calendar c LEFT JOIN shipped s ON s.cell = n_nationkey AND s.date = c.date"""),
    "driver": (("sparse_driver",), """SELECT cell, date, coalesce(mm, 0) AS mm,
        sum(coalesce(mm, 0)) OVER (PARTITION BY cell ORDER BY date) AS cum FROM sparse_driver"""),
    "campaign_readings": (("readings",), """SELECT entity, season_year, season, max(date) AS date,
        arg_max(value, date) AS value FROM readings GROUP BY 1, 2, 3"""),
    "changes": (("readings",), """SELECT *, value - value_start AS delta, CAST(date - prev_date AS INT) AS gap,
        CASE WHEN season_year <= 1998 THEN 'train' WHEN season_year = 1999 THEN 'valid' ELSE 'test' END AS split
        FROM (SELECT *, lag(value) OVER w AS value_start, lag(date) OVER w AS prev_date, lag(season) OVER w AS prev_season
              FROM readings WINDOW w AS (PARTITION BY entity ORDER BY date))
        WHERE value_start IS NOT NULL AND date - prev_date BETWEEN 45 AND 400"""),
    "intervals": (("changes", "entities"), "SELECT * FROM changes JOIN entities USING (entity)"),
    # in two steps: joined at once, the two driver look-ups would meet each other first
    "with_end": (("intervals", "driver"), """SELECT i.*, d.cum AS end_cum FROM intervals i
        JOIN driver d ON d.cell = i.cell AND d.date = i.date"""),
    "with_driver": (("with_end", "driver"), """SELECT i.* EXCLUDE (end_cum), end_cum - d.cum AS interval_mm FROM with_end i
        JOIN driver d ON d.cell = i.cell AND d.date = i.prev_date"""),
    "lines": (("with_driver",), """SELECT season, regr_intercept(delta, interval_mm) AS intercept,
        regr_slope(delta, interval_mm) AS slope FROM with_driver WHERE split = 'train' GROUP BY season"""),
    "scored": (("with_driver", "lines"), """SELECT w.*, intercept + slope * interval_mm AS expected,
        delta - (intercept + slope * interval_mm) AS residual FROM with_driver w JOIN lines USING (season)"""),
}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    """Add a common table expression to the library."""
    _CTES[name] = (needs, sql)


def sql(needs: tuple[str, ...] | list[str], body: str) -> str:
    """``body`` with the common table expressions it needs in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for n in _CTES[name][0]:
            add(n)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        add(n)
    if not ordered:
        return body
    # DuckDB evaluates a materialised expression once, however often it is read
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n][1]})" for n in ordered) + "\n" + body
