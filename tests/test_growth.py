"""Copies of the given tables with shifted keys: what hangs on a place is worked out once a place."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import oracle
from stillwell.catalog import ORACLE, QUERIES, scores
from stillwell.operators import joins, spatial, windows
from stillwell.plans import expected, features

SMALL = "/root/testdata/sf0.001"
COPIES = 3
SHIFTS = {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"]}

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Customers and orders three times; places repeat after 401 keys, so the copies of a customer share its place."""
    folder = tmp_path_factory.mktemp("copied")
    for table in oracle.TABLES:
        target = folder / f"{table}.parquet"
        if table not in SHIFTS:
            target.symlink_to(f"{SMALL}/{table}.parquet")
            continue
        df = spark.read.parquet(f"{SMALL}/{table}.parquet")
        shifted = df.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(COPIES)])))
        shifted = shifted.withColumns({c: (F.col(c) + F.col("_i") * 401_000).cast(df.schema[c].dataType) for c in SHIFTS[table]}).drop("_i")
        pq.write_table(shifted.toArrow(), target)
    return str(folder)


def test_months_of_the_ways_are_rolled_once_a_place(spark, copied, monkeypatch):
    sizes = []

    def counted(df, *args, **kwargs):
        sizes.append(df.count())
        return rolling_rows(df, *args, **kwargs)

    rolling_rows = windows.rolling_rows
    monkeypatch.setattr(scores.windows, "rolling_rows", counted)
    scores.method_trends(spark, SMALL)
    scores.method_trends(spark, copied)
    assert sizes[0] == sizes[1] > 0


@pytest.mark.parametrize("name", ["method_trends", "method_rankings", "bilinear_features", "masked_bilinear"])
def test_results_on_copies_agree_with_sql(spark, copied, name):
    assert oracle.compare(QUERIES[name](spark, copied), oracle.duck(copied), ORACLE[name]) == []


def test_the_daily_driver_is_made_once_a_place(spark, copied, monkeypatch):
    sizes = []

    def counted(daily, *args, **kwargs):
        sizes.append(daily.count())
        return pack(daily, *args, **kwargs)

    pack = features.pack_point_driver
    monkeypatch.setattr(features, "pack_point_driver", counted)
    QUERIES["bilinear_features"](spark, SMALL)
    QUERIES["bilinear_features"](spark, copied)
    assert sizes[0] == sizes[1] > 0


def test_sums_at_a_place_keep_their_digits_late_in_a_long_record(spark):
    days = spark.range(3000).select(F.struct(F.lit(0.5).alias("lat"), F.lit(0.5).alias("lon")).alias("place"),
                                    F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                    (F.lit(1e9) + F.col("id") % 7 / 7).alias("mm"))
    rows = spark.sql("SELECT 0.5D AS lat, 0.5D AS lon, DATE '1998-03-04' AS date, DATE '1998-03-01' AS prev_date, 3 AS gap")
    got = features.attach_point_driver(rows, features.pack_point_driver(days)).first()["interval_mm"]
    last = [(i % 7) / 7 for i in range(2982, 2985)]
    assert abs(got - 3e9 - sum(last)) < 1e-6


def test_cells_in_reach_are_averaged_once_a_set(spark):
    near = spark.createDataFrame([(i, c) for i in range(40) for c in ((1, 2) if i % 2 else (2,))], "id int, cell int")
    values = spark.createDataFrame([(1, 1, 1.0), (2, 1, 3.0), (2, 2, 5.0)], "cell int, month int, mm double")
    sets = spatial.near_sets(near, "id")
    got = {tuple(r["near"]): sorted(map(tuple, r["series"])) for r in spatial.set_means(sets, values, "month", "mm").collect()}
    assert got == {(1, 2): [(1, 2.0), (2, 5.0)], (2,): [(1, 3.0), (2, 5.0)]}


def test_no_row_per_entity_and_month_is_grouped(spark, copied):
    plan = QUERIES["radius_mean"](spark, copied)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [entity" in plan and not [line for line in plan.splitlines() if "Aggregate [entity" in line and "month" in line]


def test_days_of_intervals_are_not_moved(spark):
    spans = spark.sql("SELECT 1 AS id, 7 AS cell, DATE '2000-12-30' AS prev_date, DATE '2001-01-02' AS date "
                      "UNION ALL SELECT 2, 7, DATE '2001-01-02', DATE '2001-01-02' UNION ALL SELECT 3, 8, DATE '2000-01-01', DATE '2001-01-01'")
    daily = spark.sql("SELECT 7 AS cell, explode(sequence(DATE '2000-12-01', DATE '2001-01-31', interval 1 day)) AS date").withColumn("mm", F.dayofmonth("date"))
    days = joins.days_of_intervals(spans, daily, ["id"])
    assert days.columns == ["id", "cell", "day", "mm"]
    assert sorted((r["id"], str(r["day"]), r["mm"]) for r in days.collect()) == [(1, "2000-12-31", 31), (1, "2001-01-01", 1), (1, "2001-01-02", 2)]
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "day#" in line]


def test_points_that_share_a_place_are_searched_for_once(spark, monkeypatch):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D), named_struct('x', 0D, 'y', 1D), named_struct('x', 0D, 'y', 0D))"
    polygons = spark.sql(f"SELECT 'a' AS name, {ring} AS ring")
    points = spark.range(30).selectExpr("id", "0.5D AS lat", "IF(id % 2 = 0, 0.5D, 3D) AS lon")
    sizes = []

    def counted(points, *args):
        sizes.append(points.count())
        return inside_polygon(points, *args)

    inside_polygon = spatial.inside_polygon
    monkeypatch.setattr(spatial, "inside_polygon", counted)
    got = {r["id"]: (r["name"], r["distance"]) for r in spatial.polygon_or_nearest(points, "id", polygons, "name").collect()}
    assert got == {i: ("a", 0.0 if i % 2 == 0 else 2.0) for i in range(30)} and sizes == [2]


@pytest.mark.parametrize("name", ["radius_mean", "interval_days_join", "polygon_or_nearest"])
def test_other_results_on_copies_agree_with_sql(spark, copied, name):
    assert oracle.compare(QUERIES[name](spark, copied), oracle.duck(copied), ORACLE[name]) == []


def test_a_fit_reads_rows_that_are_written_once(spark):
    rows = spark.range(400).selectExpr("id % 7 + 0D AS a", "id % 5 + 0D AS delta", "IF(id % 2 = 0, 'x', 'y') AS season")
    rows = rows.join(spark.range(7).selectExpr("id + 0D AS a", "count(*) OVER (PARTITION BY id % 3) AS b"), "a")
    _, table = expected.fit_ridge(rows, ["a"], ["season"], F.lit(True))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Range" not in plan
