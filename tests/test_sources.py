import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stillwell.operators import cleaning, quality
from stillwell.sources import geo, grid, sinks, wide


@pytest.fixture
def wide_file(tmp_path):
    head = "Station Name, State ,District,Latitude,Longitude,Type of Well,Aquifer Type,Well Depth,Reference_Sy,Jan-00,May-00,Aug-00,Nov-00,Jan-99"
    lines = ["one,S,D,10.00001,70.0,Dug Well, Unconfined ,12.5,0.02,1.0,2.0,3.0,4.0,5.0",
             "two,S,D,10.00002,70.0,-,,deep,n/a,1.0,,3.0,4.0,-5.0",
             "three,S,E,11.0,70.0,Bore,,30,0.1,1.0,2.0,x,250,6.0",
             "four,S,E,12.0,70.0,Bore,,30,0.1,1.0,2.0,3.5,199.9,6.0"]
    path = tmp_path / "wells.csv"
    path.write_text("\n".join([head, *lines]))
    return str(path)


def test_wide_file_to_readings(spark, wide_file):
    readings, stations = wide.load_readings(spark, wide_file)
    uids = sorted(r["well_uid"] for r in stations.select("well_uid").collect())
    assert uids == ["10.0_70.0_0", "10.0_70.0_1", "11.0_70.0", "12.0_70.0"]
    got = {(r["well_uid"], r["campaign_date"]): r for r in readings.collect()}
    # the second and third stations keep too few readings in range
    assert {k[0] for k in got} == {"10.0_70.0_0", "12.0_70.0"} and len(got) == 10
    row = got["10.0_70.0_0", dt.date(1999, 1, 15)]
    assert (row["season"], row["season_year"], row["depth_mbgl"]) == ("JAN", 1999, 5.0)
    assert (row["aquifer"], row["well_type"], row["well_depth_m"]) == ("unconfined", "dug well", 12.5)
    odd = stations.where("well_uid = '10.0_70.0_1'").first()
    assert (odd["well_depth_m"], odd["sy"], odd["aquifer"], odd["well_type"]) == (None, None, "unknown", "unknown")


def test_two_digit_years(spark):
    df = spark.createDataFrame([("Nov-49",), ("Nov-50",)], "campaign string")
    assert [r["season_year"] for r in wide.parse_campaign(df).collect()] == [2049, 1950]
    assert [r["season_year"] for r in wide.parse_campaign(df, pivot=None).collect()] == [2049, 2050]


def test_grid_keeps_land_and_missing(spark, tmp_path):
    d = [dt.date(2000, 12, 31), dt.date(2001, 1, 1)]
    df = spark.createDataFrame([(1.0, 1.0, d[0], 1.26), (1.0, 1.0, d[1], None), (1.0, 2.0, d[0], float("nan")), (1.0, 2.0, d[1], None)],
                               "lat double, lon double, date date, mm double")
    packed = grid.pack_grid(df)
    assert [(r["date"], r["mm10"]) for r in packed.orderBy("date").collect()] == [(d[0], 13), (d[1], None)]
    assert [r["mm"] for r in grid.unpack(packed).orderBy("date").collect()] == [1.3, None]
    daily = df.where("lon = 1.0").select(F.lit(7).alias("cell"), "date", "mm")
    grid.export_by_year(daily, str(tmp_path / "rain"))
    back = spark.read.parquet(str(tmp_path / "rain")).orderBy("date").collect()
    assert [(r["year"], r["cell"], r["code"]) for r in back] == [(2000, 7, 27), (2001, 7, 0)]
    assert grid.national_mean(daily).orderBy("date").first()["mean_mm"] == 1.26


def test_towns_file(spark, tmp_path):
    fields = [""] * 19

    def line(name, ascii_name, alts, country, pop):
        f = list(fields)
        f[1], f[2], f[3], f[4], f[5], f[8], f[14] = name, ascii_name, alts, "12.9", "77.6", country, pop
        return "\t".join(f)

    path = tmp_path / "towns.txt"
    path.write_text("\n".join([line("Bengaluru", "Bengaluru", "Bangalore,Bangalor,बेंगलुरु", "IN", "8443675"),
                               line("Small", "Small", "", "IN", "4999"), line("Paris", "Paris", "", "FR", "2000000"), line("None", "None", "", "IN", "")]))
    got = geo.read_towns(spark, str(path), "IN").collect()
    assert [(r["name"], r["others"], r["population"]) for r in got] == [("Bengaluru", ["Bangalor", "Bangalore"], 8443675)]


def test_outlines_and_dams(spark, tmp_path):
    box = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    far = [[x + 5, y] for x, y in box]
    shapes = {"features": [{"properties": {"n": "A", "s": "S"}, "geometry": {"type": "Polygon", "coordinates": [box]}},
                           {"properties": {"n": "B", "s": "S"}, "geometry": {"type": "MultiPolygon", "coordinates": [[box], [far]]}}]}
    (tmp_path / "d.geojson").write_text(json.dumps(shapes))
    got = geo.read_outlines(spark, str(tmp_path / "d.geojson"), {"n": "name", "s": "state"}).collect()
    assert sorted((r["name"], r["ring"][1]["x"]) for r in got) == [("A", 1.0), ("B", 1.0), ("B", 6.0)]
    (tmp_path / "dams.csv").write_text("id_v11,lat,lon,rv_mcm_v11,id_grd_v13,qa_rank\n1,10,70,12.34,-999,high\n2,11,71,-999,42,low\n")
    dams = geo.read_dams(spark, str(tmp_path / "dams.csv")).orderBy("id").collect()
    assert [(r["storage_mcm"], r["grand_id"], r["qa"]) for r in dams] == [(12.3, None, "high"), (None, 42, "low")]


def test_documents_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.date(2000, 5, 15), 2.0, "D"), ("a", dt.date(2000, 1, 15), 1.0, "D")], "entity string, date date, v double, d string")
    docs = sinks.history_documents(rows, "entity", ["d"], "date", {"v": F.col("v")})
    sinks.write_documents(docs, str(tmp_path / "docs"))
    back = spark.read.json(str(tmp_path / "docs")).first()
    assert [h["v"] for h in back["h"]] == [1.0, 2.0] and back["d"] == "D"
    sinks.write_table(rows, str(tmp_path / "t"), by=["d"], sort=["date"])
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_spec_guard_and_checks(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 3.0)], "well_uid string, x double, delta_h_m double")
    spec = {r["column"]: (r["role"], r["kind"]) for r in cleaning.feature_spec(df, "delta_h_m").collect()}
    assert spec == {"well_uid": ("meta", "numeric"), "x": ("feature", "numeric"), "delta_h_m": ("target", "numeric")}
    cleaning.assert_no_leakage(["x"], "delta_h_m")
    with pytest.raises(ValueError):
        cleaning.assert_no_leakage(["x", "depth_mbgl"], "delta_h_m")
    with pytest.raises(ValueError):
        quality.require(quality.quality_checks(df, "well_uid", ["x"], {}))
    quality.require(quality.quality_checks(df.limit(1), "well_uid", [], {"well_uid": ["a"]}))


def test_rows_are_numbered_in_file_order_over_files_and_blocks(spark, tmp_path):
    """Three files of unequal size, the largest last and cut into blocks; one place is in all of them."""
    rows, number = [], 0
    for name, count in [("a", 3), ("b", 40), ("c", 900)]:
        lines = []
        for k in range(count):
            lat = "10.00001" if k % 3 == 0 else f"{20 + number / 100:.4f}"
            lines.append(f"{name}{k}, {lat},70.5")
            rows.append((f"{name}{k}", number, lat == "10.00001"))
            number += 1
        (tmp_path / f"{name}.csv").write_text("Station Name , Latitude,Longitude\n" + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows_in = wide.read_wide(spark, str(tmp_path))
        assert rows_in.select(F.spark_partition_id()).distinct().count() > 1
        got = cleaning.coordinate_key(rows_in.selectExpr("`Station Name` AS s", "cast(trim(Latitude) AS double) AS lat", "cast(Longitude AS double) AS lon", "file_row"),
                                      "lat", "lon", "file_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.s, r.file_row) for r in got) == sorted((s, n) for s, n, _ in rows)
    shared = [s for s, _, same in rows if same]
    assert {r.s: r.well_uid for r in got if r.s in set(shared)} == {s: f"10.0_70.5_{k}" for k, s in enumerate(shared)}
