import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwell.operators import aggregates, encode, series, windows
from stillwell.plans import features, sequences

D0 = dt.date(1998, 1, 1)


def daily(spark, values, cell=1, start=D0):
    rows = [(cell, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell int, date date, mm double")


def readings(spark, rows):
    return spark.createDataFrame([(e, dt.date.fromisoformat(d), float(v), "JAN", int(d[:4])) for e, d, v in rows],
                                 "entity string, date date, value double, season string, season_year int")


def day(i):
    return (D0 + dt.timedelta(days=i)).isoformat()


def attach(spark, rows, grid, **kw):
    packed = features.pack_driver(grid)
    table = features.changes(readings(spark, rows)).withColumn("cell", F.lit(1))
    return features.attach_driver(table, packed, **kw)


def test_interval_leaves_out_the_previous_day_and_counts_the_reading_day(spark):
    values = [0.0] * 200
    values[50], values[51], values[120] = 100.0, 10.0, 1.0
    row = attach(spark, [("a", day(50), 1), ("a", day(120), 2)], daily(spark, values)).first()
    assert row["interval_mm"] == 11.0 and row["max_day_mm"] == 10.0 and row["delta"] == 1.0


def test_thresholds_are_at_least(spark):
    values = [0.0] * 200
    values[60], values[61], values[62], values[63] = 2.5, 35.0, 2.4999, 34.9999
    row = attach(spark, [("a", day(50), 1), ("a", day(120), 2)], daily(spark, values)).first()
    assert (row["wet_days"], row["heavy_days"]) == (3, 1)
    assert row["per_wet_day"] == pytest.approx((2.5 + 35 + 2.4999 + 34.9999) / 3)


def test_a_window_that_starts_before_the_record_is_null_but_the_interval_is_not(spark):
    row = attach(spark, [("a", day(-60), 1), ("a", day(19), 2)], daily(spark, [1.0] * 100)).first()
    assert row["interval_mm"] == 20.0 and row["mm_30d"] is None
    late = attach(spark, [("a", day(-60), 1), ("a", day(29), 2)], daily(spark, [1.0] * 100)).first()
    assert late["mm_30d"] == 30.0


def test_missing_days_count_as_zero(spark):
    row = attach(spark, [("a", day(0), 1), ("a", day(90), 2)], daily(spark, [None] * 200)).first()
    assert row["interval_mm"] == 0.0 and row["max_day_mm"] == 0.0


def test_lags_run_over_surviving_rows_only(spark):
    rows = [("a", day(0), 1), ("a", day(100), 2), ("a", day(600), 5), ("a", day(700), 9), ("a", day(800), 10)]
    table = features.history(attach(spark, rows, daily(spark, list(range(900))))).orderBy("date").collect()
    assert [r["date"].isoformat() for r in table] == [day(100), day(700), day(800)]
    assert table[1]["value_start"] == 5.0                       # the dropped reading still is the previous one
    assert table[1]["interval_mm_lag1"] == table[0]["interval_mm"]
    assert table[2]["interval_mm_lag2"] == table[0]["interval_mm"]
    assert table[2]["interval_mm_prior4"] is None


def test_step_limits_are_inclusive(spark):
    rows = [("a", day(0), 0), ("a", day(45), 30), ("a", day(89), 31), ("a", day(489), 0), ("b", day(0), 0), ("b", day(50), 31)]
    got = features.changes(readings(spark, rows), largest=30.0).select("entity", "gap").collect()
    assert sorted(map(tuple, got)) == [("a", 45)] or sorted(map(tuple, got)) == [("a", 45), ("a", 400)]
    assert ("a", 44) not in [tuple(r) for r in got] and ("b", 50) not in [tuple(r) for r in got]


def test_zero_normal_gives_no_ratio_and_no_training_row_gives_no_normal(spark):
    rows = [("a", "1998-01-15", 1), ("a", "1998-05-15", 2), ("a", "1999-05-15", 3), ("b", "1999-01-15", 1), ("b", "1999-05-15", 1)]
    entities = spark.createDataFrame([("a", 1), ("b", 1)], "entity string, cell int")
    table = features.feature_table(readings(spark, rows), entities, features.pack_driver(daily(spark, [0.0] * 800)),
                                   (1998, 1998), (1999, 1999), (2000, 2000)).collect()
    by = {(r["entity"], r["season_year"]): r for r in table}
    assert by["a", 1999]["normal_season_mm"] == 0.0 and by["a", 1999]["anom_season_ratio"] is None
    assert by["b", 1999]["normal_season_mm"] is None and by["b", 1999]["anom_season_mm"] is None


def test_salted_lookup_gives_the_same_rows(spark):
    rng = np.random.default_rng(0)
    grid = daily(spark, rng.gamma(0.3, 20, 900))
    rows = [(f"e{i}", day(int(d)), float(d)) for i in range(20) for d in np.sort(rng.choice(800, 5, replace=False))]
    plain = attach(spark, rows, grid).orderBy("entity", "date").collect()
    salted = attach(spark, rows, grid, salts=5).orderBy("entity", "date").collect()
    assert plain == salted and len(plain) > 10


def test_trailing_windows_agree_with_pandas(spark):
    values = np.random.default_rng(1).gamma(0.3, 20, 120)
    got = windows.trailing_days(daily(spark, values), "mm", [30, 60]).orderBy("date").toPandas()
    for d in (30, 60):
        want = pd.Series(values).rolling(d, min_periods=d).sum()
        np.testing.assert_allclose(got[f"mm_{d}d"].astype(float), want, atol=1e-9)


def test_interval_join_agrees_with_packed_prefix(spark):
    grid = daily(spark, np.random.default_rng(2).gamma(0.3, 20, 400))
    rows = attach(spark, [("a", day(-60), 1), ("a", day(30), 1), ("a", day(100), 2), ("a", day(390), 5), ("a", day(450), 5)], grid)
    again = series.interval_sums_by_join(rows, grid, "mm", "again").orderBy("date").collect()
    assert len(again) == 4
    for r in again:
        assert r["again"] == pytest.approx(r["interval_mm"])


def test_circular_mean_wraps(spark):
    values = np.random.default_rng(3).random(365)
    slots = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "cell int, slot int, normal double")
    got = windows.circular_mean(slots, "normal", "smooth", 31).orderBy("slot").toPandas()["smooth"]
    padded = np.concatenate([values[-15:], values, values[:15]])
    np.testing.assert_allclose(got, np.convolve(padded, np.ones(31) / 31, "valid"))


def test_week_channels_agree_with_numpy(spark):
    n, weeks = 900, 104
    values = np.random.default_rng(4).gamma(0.3, 20, n)
    grid = daily(spark, values)
    normals = sequences.smoothed_normals(grid, F.year("date") <= 1999)
    rows = [("a", day(600), 1), ("a", day(727), 2), ("a", day(801), 2), ("a", day(899), 3)]
    table = features.changes(readings(spark, rows)).withColumn("cell", F.lit(1))
    packed = sequences.pack_weeks(grid, normals)
    got = {r["date"]: r["weeks"] for r in sequences.attach_weeks(sequences.attach_cell_weeks(table, packed)).collect()}
    assert len(got[D0 + dt.timedelta(days=727)]) == weeks
    for end, gap in ((727, 127), (801, 74), (899, 98)):
        w = got[D0 + dt.timedelta(days=end)]
        start = end + 1 - weeks * 7
        block = values[start:end + 1].reshape(weeks, 7)
        np.testing.assert_allclose([x["rain_mm"] for x in w], block.sum(1), atol=1e-9)
        np.testing.assert_allclose([x["wet_frac"] for x in w], (block >= 2.5).mean(1))
        lo = end - gap + 1
        share = np.clip(start + 7 * np.arange(weeks) + 7 - lo, 0, 7) / 7
        np.testing.assert_allclose([x["in_interval"] for x in w], share)
        mid = [(D0 + dt.timedelta(days=start + 7 * k + 3)).timetuple().tm_yday for k in range(weeks)]
        np.testing.assert_allclose([x["doy_sin"] for x in w], np.sin(2 * np.pi * (np.array(mid) - 1) / 365.25), atol=1e-12)
    early = [("a", day(600), 1), ("a", day(700), 2)]
    table = features.changes(readings(spark, early)).withColumn("cell", F.lit(1))
    assert sequences.attach_cell_weeks(table, packed).first()["weeks"] is None


def test_scaling_the_driver_moves_the_anomaly_with_it(spark):
    rows = spark.createDataFrame([(10.0, -3.0, 0.5)], "rain_mm double, rain_anom_mm double, wet_frac double")
    got = sequences.scale_rain(rows, 1.2).first()
    assert (got["rain_mm"], got["rain_anom_mm"], got["wet_frac"]) == (12.0, pytest.approx(-1.0), 0.5)


def test_encoding_uses_training_rows_and_a_bucket_for_unseen_levels(spark):
    rows = spark.createDataFrame([(1.0, "b", "train"), (None, "a", "train"), (4.0, None, "train"), (9.0, "z", "test")],
                                 "x double, c string, split string")
    train = F.col("split") == "train"
    stats = encode.saved(encode.numeric_stats(rows, ["x"], train))
    filled = np.array([1.0, 2.5, 4.0])
    assert stats["x"] == pytest.approx({"median": 2.5, "mean": filled.mean(), "std": filled.std()})
    coded = encode.encode_category(rows, "c", encode.category_levels(rows, "c", train), "code")
    assert {(r["c"], r["code"]) for r in coded.collect()} == {("a", 0), ("b", 1), (None, 2), ("z", 3)}
    x = [r["x"] for r in encode.encode_numeric(rows, ["x"], stats).collect()]
    np.testing.assert_allclose(sorted(x), sorted((np.array([1.0, 2.5, 4.0, 9.0]) - filled.mean()) / filled.std()))


def test_time_bins_cover_every_point(spark):
    n, bins = 50, 7
    df = spark.createDataFrame([(i, float(i * i)) for i in range(n)], "i int, v double")
    got = {r["bin"]: r["v"] for r in aggregates.time_bins(df, "i", "v", n, bins).collect()}
    for x in range(bins):
        a, b = x * n // bins, max(x * n // bins + 1, (x + 1) * n // bins)
        assert got[x] == pytest.approx(np.mean([i * i for i in range(a, b)]))
    few = aggregates.time_bins(df.where("i < 3"), "i", "v", 3, 8).orderBy("bin").collect()
    assert [r["v"] for r in few] == [float((x * 3 // 8) ** 2) for x in range(8)]


def test_as_of_lookup_takes_the_last_event(spark):
    asked = spark.createDataFrame([("a", dt.date(2000, 1, d)) for d in (1, 5, 5, 9)], "k string, day date")
    events = spark.createDataFrame([("a", dt.date(2000, 1, d), d) for d in (3, 5, 8)], "k string, at date, v int")
    got = series.latest_at_or_before(asked, events, ["k"], "day", "at", ["v"]).orderBy("day").collect()
    assert [r["v"] for r in got] == [None, 5, 5, 8]
