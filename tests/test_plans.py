import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwell.operators import series
from stillwell.plans import attribution, expected, features, forecast, review, scenario


@pytest.fixture(scope="module")
def world(spark):
    """Ten years of a driver over three cells; the expected change falls as the driver rises."""
    rng = np.random.default_rng(0)
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(3653)]
    daily = spark.createDataFrame([(c, d, float(v)) for c in range(3) for d, v in zip(days, rng.gamma(0.3, 15, len(days)).round(1))],
                                  "cell int, date date, mm double").repartition(4).cache()
    people = spark.createDataFrame([(i, i % 3, f"d{i % 4}", f"s{i % 2}") for i in range(24)], "entity int, cell int, grp string, state string")
    lines = spark.createDataFrame([(s, 1.0 + k, -0.01 - 0.002 * k) for k, s in enumerate(("JAN", "MAY", "AUG", "NOV"))],
                                  "season string, intercept double, slope double")
    return daily, people, lines


@pytest.fixture(scope="module")
def table(world):
    daily, _, lines = world
    return forecast.step_table(forecast.regular_intervals(features.pack_driver(daily), 2000, 2009), lines).cache()


def _readings(spark, entities=24):
    rng = np.random.default_rng(1)
    rows = [(e, y, s, dt.date(y, m, 15), float(rng.normal(10, 2))) for e in range(entities) for y in range(2003, 2010)
            for s, m in (("JAN", 1), ("MAY", 5), ("AUG", 8), ("NOV", 11)) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "entity int, season_year int, season string, date date, value double")


def scenario_table(spark, pct, keep=None):
    rng = np.random.default_rng(2)
    rows = [(i, 2008, "NOV", float(rng.uniform(50, 400)), float(rng.uniform(0, 6)), f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "entity int, season_year int, season string, interval_mm double, value_start double, state string")
    lines = spark.createDataFrame([("NOV", 1.0, -0.01)], "season string, intercept double, slope double")
    return scenario.scenario_summary(scenario.scenario_rows(df, lines, 2008, pct, (2007, 2009), keep=keep)).first()


def test_no_change_changes_nothing(spark):
    row = scenario_table(spark, 0.0)
    assert row["level_vs_recorded"] == 0 and row["waterlogged_vs_recorded"] == 0 and row["falling"] + row["rising"] == 60


def test_more_driver_means_less_fall(spark):
    rows = [scenario_table(spark, p) for p in (-40.0, 0.0, 20.0)]
    assert rows[0]["mean_change"] > rows[1]["mean_change"] > rows[2]["mean_change"]
    assert rows[0]["waterlogged_vs_recorded"] <= 0 <= rows[2]["waterlogged_vs_recorded"]


def test_filter_keeps_only_its_state(spark):
    assert scenario_table(spark, -10.0, F.col("state") == "s1")["entities"] == 20


@pytest.mark.parametrize("year,pct", [(2008, 80), (2008, -51), (2006, 0), (2010, 0)])
def test_scenario_limits(world, spark, year, pct):
    with pytest.raises(ValueError):
        scenario.scenario_rows(spark.createDataFrame([(2008, "NOV", 1.0)], "season_year int, season string, interval_mm double"),
                               world[2], year, pct, (2007, 2009))


@pytest.mark.parametrize("start,end,factor,add", [
    ("2005-02-01", "2005-01-01", 1.1, 0), ("1999-01-01", "2005-01-01", 1.1, 0), ("2005-01-01", "2005-01-02", 1, 0)])
def test_edit_requests_are_checked(start, end, factor, add):
    with pytest.raises(ValueError):
        scenario.check_edits([scenario.Edit(dt.date.fromisoformat(start), dt.date.fromisoformat(end), factor, add)], dt.date(2000, 1, 1), dt.date(2045, 12, 31))


def test_long_edits_are_allowed():
    scenario.check_edits([scenario.Edit(dt.date(2001, 1, 1), dt.date(2009, 1, 1), 1.5)], dt.date(2000, 1, 1), dt.date(2045, 12, 31))


def test_edits_apply_in_order_and_never_below_zero(spark):
    d = dt.date(2001, 1, 1)
    df = spark.createDataFrame([(10.0, d), (None, d)], "mm double, date date")
    edits = [scenario.Edit(d, d, 2.0, 5.0), scenario.Edit(d, d, 1.0, -40.0)]
    assert [r["mm"] for r in scenario.edited_driver(df, edits).collect()] == [0.0, 0.0]


def test_past_wetter_season_has_a_negative_effect(world, spark):
    daily, people, lines = world
    edits = [scenario.Edit(dt.date(2006, 6, 1), dt.date(2006, 9, 30), 1.15)]
    effect = scenario.interval_effect(daily, lines, edits, 1, 2000, 2009)
    bands = scenario.cumulative_effect(effect, people).orderBy("step").collect()
    assert bands[0]["date"] == dt.date(2006, 8, 15) and bands[-1]["p50"] < 0
    assert all(b["p10"] == b["p50"] == b["p90"] for b in bands)
    seen = {(r["date"].year, r["date"].month): r for r in bands}
    base = daily.where((F.col("date") > "2006-05-15") & (F.col("date") <= "2006-08-15") & (F.col("date") >= "2006-06-01"))
    want = base.join(people, "cell").agg(F.sum("mm") / 24).first()[0] * 0.15 * -0.014
    assert seen[2006, 8]["p50"] == pytest.approx(want)


def test_future_edit_uses_replayed_days(world, spark):
    daily, people, lines = world
    edits = [scenario.Edit(dt.date(2012, 10, 9), dt.date(2012, 10, 9), 1.0, 40.0)]
    effect = scenario.interval_effect(daily, lines, edits, 10, 2000, 2009)
    bands = scenario.cumulative_effect(effect, people).orderBy("step").collect()
    assert bands[0]["date"] == dt.date(2012, 11, 15) and len(bands) == 8
    assert all(b["p50"] == pytest.approx(-0.016 * 40) for b in bands)       # adding rain does not depend on the member
    assert scenario.peak(scenario.cumulative_effect(effect, people)).first()["step"] == 1


def test_forecast_bands_and_dates(world, table, spark):
    _, people, _ = world
    readings = _readings(spark)
    start = forecast.starts(readings, forecast.at_shift(table, 0), people, 2009)
    future = forecast.future_steps(spark, 2000, 2009, 2017)
    rows = forecast.bands(forecast.mean_paths(start, forecast.at_shift(table, 0), future)).orderBy("step_no").collect()
    assert (rows[0]["date"], rows[-1]["date"]) == (dt.date(2010, 1, 15), dt.date(2017, 11, 15))
    assert all(r["rain_p10"] <= r["rain_p50"] <= r["rain_p90"] for r in rows)
    assert not rows[19]["beyond_tested_skill"] and rows[20]["beyond_tested_skill"]


def test_drier_ends_deeper(world, table, spark):
    _, people, _ = world
    future = forecast.future_steps(spark, 2000, 2009, 2012)
    ends = []
    for pct in (-20, 5, 20):
        shifted = forecast.at_shift(table, pct)
        start = forecast.starts(_readings(spark), shifted, people, 2009)
        last = forecast.bands(forecast.mean_paths(start, shifted, future)).orderBy(F.desc("step_no")).first()
        ends.append(last["rain_p50"])
    assert ends[0] > ends[1] > ends[2]


def test_shift_is_linear_and_clamped(table):
    def mean(t):
        return t.agg(F.avg("step")).first()[0]
    low, high = mean(forecast.at_shift(table, -20)), mean(forecast.at_shift(table, -10))
    assert mean(forecast.at_shift(table, -13)) == pytest.approx(0.3 * low + 0.7 * high)
    assert mean(forecast.at_shift(table, -90)) == pytest.approx(mean(forecast.at_shift(table, -30)))


def test_catch_up_covers_the_last_year_only(world, table, spark):
    _, people, _ = world
    rows = [(0, 2009, "MAY", dt.date(2009, 5, 15), 5.0), (1, 2006, "AUG", dt.date(2006, 8, 15), 5.0), (2, 2009, "NOV", dt.date(2009, 11, 15), 5.0)]
    readings = spark.createDataFrame(rows, "entity int, season_year int, season string, date date, value double")
    steps = forecast.at_shift(table, 0)
    got = {r["entity"]: r["base"] for r in forecast.starts(readings, steps, people, 2009).collect()}
    of = {(r["cell"], r["season"]): r["step"] for r in steps.where("year = 2009").collect()}
    assert got[0] == pytest.approx(5 + of[0, "AUG"] + of[0, "NOV"])
    assert got[1] == pytest.approx(5 + sum(of[1, s] for s in ("JAN", "MAY", "AUG", "NOV")))
    assert got[2] == 5.0


def test_backtest_is_exact_when_the_steps_are(world, table, spark):
    """Readings that follow the steps give no error for the driver predictor."""
    _, people, _ = world
    steps = {(r["cell"], r["year"], r["season"]): r["step"] for r in table.where("shift = 0").collect()}
    rows, months = [], {"JAN": 1, "MAY": 5, "AUG": 8, "NOV": 11}
    for e in range(6):
        h = 10.0
        for y in range(2003, 2010):
            for s, m in months.items():
                h += steps[e % 3, y, s]
                rows.append((e, y, s, dt.date(y, m, 15), h))
    readings = spark.createDataFrame(rows, "entity int, season_year int, season string, date date, value double")
    out = forecast.backtest(readings, people, table.where("shift = 0"), 2006, 2009).orderBy("years_ahead").collect()
    assert [r["years_ahead"] for r in out] == [1, 2, 3] and [r["n"] for r in out] == [24, 24, 24]
    assert all(r["rain_only_mae"] == pytest.approx(0, abs=1e-9) and r["persistence_mae"] > 0 for r in out)


def test_backtest_refuses_rates_that_saw_the_future(world, table, spark):
    _, people, _ = world
    readings = spark.createDataFrame([], "entity int, season_year int, season string, date date, value double")
    rate = spark.createDataFrame([("g", "s", "NOV", 0.1)], "grp string, state string, season string, rate double")
    for years in (None, (2003, 2007)):
        with pytest.raises(ValueError):
            forecast.backtest(readings, people, table, 2006, 2009, rate, years)
    forecast.backtest(readings, people, table, 2006, 2009, rate, (2003, 2006))


def _residual_rows(spark, rows):
    return spark.createDataFrame(rows, "grp string, state string, season_year int, entity int, residual double").withColumns(
        {"delta": F.col("residual") + 1, "expected": F.lit(1.0), "season": F.lit("NOV")})


def test_years_count_equally_and_names_repeat_across_states(spark):
    rows = [("x", "A", 2018, 1, 1.0), ("x", "A", 2018, 2, 1.0)] + [("x", "A", 2019, i, 4.0) for i in range(10)]
    rows += [("x", "A", 2020, i, 1.0) for i in (1, 2)] + [("x", "B", y, i, -1.0) for y in (2018, 2019, 2020) for i in (50, 51)]
    rows += [("y", "A", y, 9, 99.0) for y in (2018, 2019, 2020)]          # one entity: not enough
    cube = attribution.pressure_cube(_residual_rows(spark, rows))
    ranked = attribution.pressure_rank(cube, 2018, 2020, (2015, 2022)).collect()
    assert [(r["grp"], r["state"], r["unexplained"]) for r in ranked] == [("x", "A", 2.0), ("x", "B", -1.0)]
    assert ranked[0]["entities_latest"] == 2
    best = attribution.pressure_rank(cube, 2018, 2020, (2015, 2022), best_first=True).first()
    assert best["state"] == "B"
    with pytest.raises(ValueError):
        attribution.pressure_rank(cube, 2005, 2020, (2015, 2022))
    assert attribution.pressure_rank(cube, 2005, 2020, (2015, 2022), allow_training=True).count() == 2
    with pytest.raises(ValueError):
        attribution.group_series(cube, "X", (2015, 2022))
    with pytest.raises(LookupError):
        attribution.group_series(cube, "nowhere", (2015, 2022))
    assert attribution.group_series(cube, "X", (2015, 2022), "b").count() == 3


def test_rates_fall_back_to_the_state_then_zero(spark):
    rows = [("a", "S", 2018, 1, 2.0), ("a", "S", 2018, 2, 4.0), ("b", "S", 2018, 3, 9.0), ("c", "T", 2018, 4, 7.0)]
    df = _residual_rows(spark, rows)
    groups = spark.createDataFrame([("a", "S"), ("b", "S"), ("c", "T")], "grp string, state string")
    got = {(r["grp"], r["season"]): r["rate"] for r in attribution.rates(df, groups).collect()}
    assert got["a", "NOV"] == 3.0 and got["b", "NOV"] == 5.0 and got["c", "NOV"] == 0.0 and got["a", "MAY"] == 0.0
    assert len(got) == 12


def test_ensemble_weight_grid_matches_direct_scores(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(0, 2, 300)
    a, b = y + rng.normal(0, 1, 300), y + rng.normal(0, 1.5, 300)
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(y, a, b)], "y double, a double, b double")
    table = review.ensemble_weights(df, "y", "a", "b")
    want = {round(w, 2): 1 - ((w * a + (1 - w) * b - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() for w in np.linspace(0, 1, 21)}
    got = {round(r["weight"], 2): r["r2"] for r in table.collect()}
    assert got == pytest.approx(want)
    assert round(review.best_weight(table).first()["weight"], 2) == max(want, key=want.get)


def test_season_mean_falls_back_for_an_unseen_season(spark):
    df = spark.createDataFrame([("JAN", 1.0, "train"), ("JAN", 3.0, "train"), ("MAY", 8.0, "train"), ("AUG", 0.0, "valid")],
                               "season string, delta double, split string")
    got = {r["season"]: r["expected"] for r in expected.season_mean(df, F.col("split") == "train").collect()}
    assert got == {"JAN": 2.0, "MAY": 8.0, "AUG": 4.0}


def test_calendar_gap_is_reported(spark):
    df = spark.createDataFrame([(1, dt.date(2000, 1, d)) for d in (1, 2, 4)], "cell int, date date")
    row = series.calendar_gaps(df).first()
    assert (row["days"], row["span"], row["missing"]) == (3, 4, 1)
