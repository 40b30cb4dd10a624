"""Attribution, scenario and forecast jobs on the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import aggregates
from ..plans import attribution, expected, features, forecast, review, scenario, sequences
from ..session import cut_lineage
from . import analog
from .analog import define, sql
from .registry import R, query, rounded
from .features import _in_train

HELD = analog.HELD_OUT

# ---------------------------------------------------------------- attribution
define("cube", ("scored",), """SELECT grp, state, season_year, round(avg(residual) + 1e-9, 3) AS resid, round(avg(delta) + 1e-9, 3) AS obs,
    round(avg(expected) + 1e-9, 3) AS exp, count(*) AS n, count(DISTINCT entity) AS entities FROM scored GROUP BY 1, 2, 3
    HAVING count(DISTINCT entity) >= 2""")


def _off_halves(rows):
    """The same shift the comparison uses, since these jobs round their results themselves."""
    return rows.withColumns({c: F.col(c) + 1e-9 for c in ("residual", "delta", "expected")})


def cube(spark, sf):
    return attribution.pressure_cube(_off_halves(analog.scored(spark, sf)))


@query("expected_change", sql(["scored"], f"SELECT entity, date, {R('expected')} AS expected, {R('residual')} AS residual FROM scored"))
def expected_change(spark, sf):
    return rounded(analog.scored(spark, sf).select("entity", "date", "expected", "residual"))


@query("season_lines", sql(["lines"], f"SELECT season, {R('intercept', 5)} AS intercept, {R('slope')} AS slope FROM lines"))
def season_lines(spark, sf):
    return rounded(analog.lines(analog.with_driver(spark, sf, "interval_mm")), intercept=5)


@query("pressure_cube", sql(["cube"], "SELECT * FROM cube"))
def pressure_cube(spark, sf):
    return cube(spark, sf)


_RANKED = """SELECT grp, state, avg(resid) AS unexplained, avg(obs) AS observed, avg(exp) AS explained, count(*) AS years,
    arg_max(entities, season_year) AS entities_latest FROM cube WHERE season_year BETWEEN 1999 AND 2001 GROUP BY 1, 2 HAVING count(*) >= 3"""
_SHOWN = f"grp, state, {R('unexplained')} AS unexplained, {R('observed')} AS observed, {R('explained')} AS explained, years, entities_latest"


@query("pressure_rank", sql(["cube"], f"SELECT {_SHOWN} FROM ({_RANKED}) ORDER BY unexplained DESC, grp, state LIMIT 25"))
def pressure_rank(spark, sf):
    return rounded(attribution.pressure_rank(cube(spark, sf), *HELD, HELD, top=25))


@query("pressure_best", sql(["cube"], f"SELECT {_SHOWN} FROM ({_RANKED}) t ORDER BY t.unexplained, grp, state LIMIT 10"))
def pressure_best(spark, sf):
    return rounded(attribution.pressure_rank(cube(spark, sf), *HELD, HELD, top=10, best_first=True))


@query("group_series", sql(["cube"], "SELECT grp, state, season_year, resid, obs, exp, n, entities, season_year >= 1999 AS held_out FROM cube WHERE lower(grp) = 'nation_3'"))
def group_series(spark, sf):
    return attribution.group_series(cube(spark, sf), "Nation_3", HELD)


@query("pressure_map", sql(["cube"], """SELECT grp, state, count(*) AS years, max(season_year) AS latest, arg_max(resid, season_year) AS resid FROM cube GROUP BY 1, 2"""))
def pressure_map(spark, sf):
    from ..sources.sinks import yearly_map
    years = yearly_map(cube(spark, sf), ["grp", "state"], "season_year", ["resid", "obs", "exp"])
    last = F.array_max(F.map_keys("years"))
    return years.select("grp", "state", F.size("years").cast("long").alias("years"), last.alias("latest"),
                        F.element_at(F.element_at("years", last), 1).alias("resid"))


@query("residual_by_group", sql(["scored"], f"""SELECT grp, {R('avg(residual)', 5)} AS resid_mean, count(*) AS n, count(DISTINCT entity) AS entities FROM scored GROUP BY 1
HAVING count(DISTINCT entity) >= 3"""))
def residual_by_group(spark, sf):
    return rounded(attribution.residual_by_group(analog.scored(spark, sf), ["grp"]), 5)


@query("entity_detail", sql(["scored"], f"""SELECT entity, count(*) AS readings, {R('avg(delta)')} AS observed, {R('avg(expected)')} AS explained,
{R('avg(delta) - avg(expected)')} AS unexplained FROM scored GROUP BY 1"""))
def entity_detail(spark, sf):
    return rounded(attribution.detail(analog.scored(spark, sf), ["entity"]))


@query("entity_history", sql(["scored"], f"""SELECT entity, date, season, {R('value')} AS value, {R('delta')} AS change, {R('expected', 5)} AS expected, {R('residual', 5)} AS unexplained,
season_year BETWEEN 1999 AND 2001 AS held_out FROM scored"""))
def entity_history(spark, sf):
    rows = analog.scored(spark, sf)
    return rounded(rows.select("entity", "date", "season", "value", F.col("delta").alias("change"), "expected",
                               F.col("residual").alias("unexplained"), F.col("season_year").between(*HELD).alias("held_out")),
                   expected=5, unexplained=5)


@query("residual_trend", sql(["scored"], f"""SELECT grp, count(DISTINCT season_year) AS points, {R('regr_slope(residual, season_year)', 5)} AS trend FROM scored GROUP BY 1
HAVING count(DISTINCT season_year) >= 7"""))
def residual_trend(spark, sf):
    return rounded(attribution.residual_trend(analog.scored(spark, sf), ["grp"], 7), 5)


define("every_group", ("scored",), "SELECT grp, avg(residual) AS a FROM scored GROUP BY 1 HAVING count(DISTINCT entity) >= 3")
define("held_group", ("scored",), "SELECT grp, avg(residual) AS b FROM scored WHERE split <> 'train' GROUP BY 1 HAVING count(DISTINCT entity) >= 3")


@query("rank_agreement", sql(["every_group", "held_group"], f"""SELECT {R('corr(ra, rb)')} AS spearman, count(*) AS common,
(SELECT count(*) FROM (SELECT grp FROM every_group ORDER BY a DESC, grp LIMIT 10) JOIN (SELECT grp FROM held_group ORDER BY b DESC, grp LIMIT 10) USING (grp)) AS top10
FROM (SELECT rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM every_group JOIN held_group USING (grp))"""))
def rank_agreement(spark, sf):
    """District ranking on all rows against held-out rows only."""
    rows = analog.scored(spark, sf)
    every = attribution.residual_by_group(rows, ["grp"])
    held = attribution.residual_by_group(rows.where("split <> 'train'"), ["grp"])
    return rounded(attribution.rank_agreement(every, held, ["grp"], "resid_mean", [10]))


# ---------------------------------------------------------------- models and checks
define("season_mean", ("changes",), """SELECT c.*, coalesce(m.v, (SELECT avg(delta) FROM changes WHERE split = 'train')) AS expected FROM changes c
    LEFT JOIN (SELECT season, avg(delta) AS v FROM changes WHERE split = 'train' GROUP BY 1) m USING (season)""")
_METRICS = f"""count(*) AS rows, {R('avg(abs(expected - delta))', 5)} AS mae, {R('sqrt(avg((expected - delta) ** 2))', 5)} AS rmse,
    {R('1 - avg((expected - delta) ** 2) / var_pop(delta)')} AS r2, {R('avg(expected - delta)', 5)} AS bias"""


def _split_changes(spark, sf):
    from ..operators.cleaning import year_split
    return features.changes(analog.readings(spark, sf)).withColumn("split", year_split(F.col("season_year"), analog.TRAIN, analog.VALID))


@query("season_mean_model", sql(["season_mean"], f"SELECT split, {_METRICS} FROM season_mean GROUP BY 1"))
def season_mean_model(spark, sf):
    rows = expected.season_mean(_split_changes(spark, sf), analog.is_train())
    return rounded(aggregates.error_metrics(rows, ["split"], "delta", "expected"), 5, r2=6)


@query("zero_model", sql(["changes"], f"SELECT split, {_METRICS.replace('expected', '0')} FROM changes GROUP BY 1"))
def zero_model(spark, sf):
    rows = expected.zero(_split_changes(spark, sf))
    return rounded(aggregates.error_metrics(rows, ["split"], "delta", "expected"), 5, r2=6)


@query("error_metrics", sql(["scored"], f"SELECT split, season, {_METRICS} FROM scored GROUP BY 1, 2"))
def error_metrics(spark, sf):
    return rounded(aggregates.error_metrics(analog.scored(spark, sf), ["split", "season"], "delta", "expected"), 5, r2=6)


define("two_models", ("scored",), """SELECT s.*, m.v AS other FROM scored s
    JOIN (SELECT season, avg(delta) AS v FROM scored WHERE split = 'train' GROUP BY 1) m USING (season)""")


def two_models(spark, sf):
    rows = analog.scored(spark, sf)
    return expected.season_mean(rows.withColumnRenamed("expected", "line"), analog.is_train()).withColumnRenamed("expected", "other")


@query("ensemble_weights", sql(["two_models"], f"""SELECT w / 20.0::DOUBLE AS weight, {R("1 - sum((w / 20.0 * expected + (1 - w / 20.0) * other - delta) ** 2) / (var_pop(delta) * count(*))")} AS r2
FROM two_models CROSS JOIN range(0, 21) g(w) WHERE split = 'valid' GROUP BY 1, w"""))
def ensemble_weights(spark, sf):
    return rounded(review.ensemble_weights(two_models(spark, sf).where("split = 'valid'"), "delta", "line", "other"))


@query("error_correlation", sql(["two_models"], f"""SELECT {R('corr(delta - expected, delta - other)')} AS corr, count(*) AS rows FROM two_models WHERE split = 'valid'"""))
def error_correlation(spark, sf):
    return rounded(review.error_correlation(two_models(spark, sf).where("split = 'valid'"), "delta", "line", "other"))


@query("skill_over_calendar", sql(["two_models"], f"""SELECT {R('1 - avg((expected - delta) ** 2) / var_pop(delta)')} AS r2, {R('1 - avg((other - delta) ** 2) / var_pop(delta)')} AS r2_baseline,
{R('(avg((other - delta) ** 2) - avg((expected - delta) ** 2)) / var_pop(delta)')} AS added FROM two_models WHERE split = 'test'"""))
def skill_over_calendar(spark, sf):
    return rounded(review.skill_over(two_models(spark, sf).where("split = 'test'"), "delta", "line", "other"))


@query("train_share", sql(["intervals"], f"SELECT grp, {R('avg(CASE WHEN split = $$train$$ THEN 1.0 ELSE 0 END)'.replace('$$', chr(39)))} AS train_share, count(*) AS rows FROM intervals GROUP BY 1"))
def train_share(spark, sf):
    return rounded(review.train_share(analog.intervals(spark, sf), ["grp"]))


@query("response_audit", sql(["with_driver", "lines"], f"""SELECT factor::DOUBLE AS factor, count(*) AS rows, {R('avg(d)')} AS mean, {R('avg(CASE WHEN factor > 1 THEN d > 1e-4 ELSE d < -1e-4 END::INT)')} AS wrong_way,
{R('quantile_cont(d, 0.1)')} AS p10, {R('quantile_cont(d, 0.9)')} AS p90 FROM (SELECT factor, (intercept + slope * (interval_mm * factor)) - (intercept + slope * interval_mm) AS d FROM with_driver JOIN lines USING (season)
CROSS JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE)) f(factor)) GROUP BY 1"""))
def response_audit(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm")
    return rounded(review.response(rows, analog.lines(rows)))


define("folds", ("scored",), """SELECT s.*, (f.place % 5)::INT AS fold FROM scored s JOIN (SELECT k, row_number() OVER (ORDER BY md5(k || '|42'), k) - 1 AS place
    FROM (SELECT DISTINCT grp AS k FROM scored)) f ON f.k = s.grp""")


@query("fold_cross_validation", sql(["folds"], f"""WITH p AS (SELECT f.fold, f.delta, m.v AS expected FROM folds f JOIN (SELECT k.fold, season, avg(delta) AS v FROM folds f
JOIN (SELECT DISTINCT fold FROM folds) k ON k.fold <> f.fold GROUP BY 1, 2) m ON m.fold = f.fold AND m.season = f.season),
e AS (SELECT fold, count(*) AS rows, avg(abs(expected - delta)) AS mae, sqrt(avg((expected - delta) ** 2)) AS rmse, 1 - avg((expected - delta) ** 2) / var_pop(delta) AS r2,
avg(expected - delta) AS bias FROM p GROUP BY 1)
SELECT fold, rows, {R('mae', 5)} AS mae, {R('rmse', 5)} AS rmse, {R('r2')} AS r2, {R('bias', 5)} AS bias FROM e
UNION ALL SELECT -1, sum(rows)::BIGINT, {R('avg(mae)', 5)}, {R('avg(rmse)', 5)}, {R('avg(r2)')}, {R('avg(bias)', 5)} FROM e""".replace(
    "WITH p AS", "SELECT * FROM (WITH p AS") + ")"))
def fold_cross_validation(spark, sf):
    """Season means fitted on four folds of groups and tested on the fifth."""
    from ..operators.splits import fold_of
    rows = analog.intervals(spark, sf)
    rows = rows.join(fold_of(rows, "grp"), "grp")
    return rounded(review.fold_metrics(expected.held_out_means(rows, "fold"), "fold"), 5, r2=6)


# ---------------------------------------------------------------- scenario
EDITS = [scenario.Edit(dt.date(1999, 6, 1), dt.date(1999, 8, 31), 1.15, 0.0),
         scenario.Edit(dt.date(1999, 8, 1), dt.date(1999, 9, 15), 0.5, 5.0)]
FUTURE = [scenario.Edit(dt.date(2003, 10, 1), dt.date(2003, 10, 20), 1.5, 40.0)]
_EDITED = """CASE WHEN {d} BETWEEN DATE '1999-08-01' AND DATE '1999-09-15' THEN greatest((CASE WHEN {d} BETWEEN DATE '1999-06-01' AND DATE '1999-08-31'
    THEN greatest(mm * 1.15::DOUBLE, 0) ELSE mm END) * 0.5::DOUBLE + 5, 0) WHEN {d} BETWEEN DATE '1999-06-01' AND DATE '1999-08-31' THEN greatest(mm * 1.15::DOUBLE, 0) ELSE mm END"""


@query("driver_edit", sql(["driver"], f"SELECT cell, date, {R(_EDITED.format(d='date'))} AS mm FROM driver"))
def driver_edit(spark, sf):
    return rounded(scenario.edited_driver(analog.driver(spark, sf), EDITS))


define("edited", ("driver",), f"SELECT cell, date, {_EDITED.format(d='date')} AS mm FROM driver")
define("edited_weeks", ("intervals", "edited", "slots", "smooth"), """SELECT CAST(103 - (i.date - d.date) // 7 AS INT) AS week, avg(d.mm) * 7 AS rain_mm, avg(d.mm - s.smooth) * 7 AS rain_anom_mm,
    avg((d.mm >= 2.5)::INT) AS wet_frac FROM intervals i JOIN edited d ON d.cell = i.cell AND d.date > i.date - 728 AND d.date <= i.date
    JOIN slots k ON k.cell = d.cell AND k.date = d.date JOIN smooth s ON s.cell = d.cell AND s.slot = k.slot WHERE i.date - DATE '1995-01-01' + 1 >= 728 GROUP BY 1""")


@query("edited_channels", sql(["edited_weeks"], f"SELECT week, {R('rain_mm')} AS rain_mm, {R('rain_anom_mm')} AS rain_anom_mm, {R('wet_frac')} AS wet_frac FROM edited_weeks"))
def edited_channels(spark, sf):
    """Channels rebuilt from the edited driver; the normals stay those of the recorded one."""
    from .features import weekly
    rows = weekly(spark, sf, [], scenario.edited_driver(analog.driver(spark, sf), EDITS))
    return rounded(rows.groupBy("week").agg(*[F.avg(c).alias(c) for c in ("rain_mm", "rain_anom_mm", "wet_frac")]))


define("regular_days", (), """SELECT make_date(y, m, 15) AS date, y::INT AS year, s AS season, CAST(make_date(y, m, 15) - to_months(b) AS DATE) AS prev_date
    FROM range(1995, 2010) g(y) CROSS JOIN (VALUES ('JAN', 1::BIGINT, 2), ('MAY', 5::BIGINT, 4), ('AUG', 8::BIGINT, 3), ('NOV', 11::BIGINT, 3)) s(s, m, b)""")
define("past_steps", ("regular_days",), """SELECT *, (row_number() OVER (ORDER BY date))::INT AS step FROM regular_days WHERE date > DATE '1999-05-31'
    AND date <= DATE '1999-09-15' + 728""")
define("future_steps", ("regular_days",), """SELECT *, (row_number() OVER (ORDER BY date))::INT AS step FROM regular_days WHERE date > DATE '2003-09-30'
    AND date <= DATE '2003-10-20' + 728""")


@query("affected_steps", sql(["past_steps", "shipped"], f"""SELECT step, s.date, prev_date, season, year, {R('m')} AS mean_mm FROM past_steps s
JOIN (SELECT date, avg(mm) AS m FROM shipped GROUP BY 1) d USING (date)"""))
def affected_steps(spark, sf):
    """Readings an edit reaches, kept where the driver was recorded on that day, with its mean over the cells."""
    steps = scenario.affected_steps(spark, EDITS, analog.FIRST_YEAR)
    days = analog.shipped(spark, sf).groupBy("date").agg(F.avg("mm").alias("mean_mm"))
    return rounded(steps.join(days, "date").select("step", "date", "prev_date", "season", "year", "mean_mm"))


define("past_effect", ("past_steps", "driver", "edited", "lines", "entities"), """SELECT 0 AS member, s.step, s.date, e.entity, slope * sum(x.mm - d.mm) AS effect
    FROM past_steps s JOIN lines USING (season) CROSS JOIN entities e JOIN driver d ON d.cell = e.cell AND d.date > s.prev_date AND d.date <= s.date
    JOIN edited x ON x.cell = d.cell AND x.date = d.date GROUP BY s.step, s.date, e.entity, slope""")
define("future_days", ("future_steps",), """SELECT m::INT AS member, s.*, d.day, CAST(d.day + to_years((1995 + (m + s.year - 2002) % 7 - s.year)::INT) AS DATE) AS source FROM future_steps s
    CROSS JOIN range(0, 7) g(m) CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2003-10-01', DATE '2003-10-20', INTERVAL 1 DAY)) AS DATE) AS day) d""")
define("future_effect", ("future_days", "future_steps", "driver", "lines", "entities"), """SELECT m::INT AS member, s.step, s.date, e.entity,
    slope * coalesce(sum(greatest(mm * 1.5 + 40, 0) - mm), 0) AS effect FROM future_steps s JOIN lines USING (season) CROSS JOIN range(0, 7) g(m) CROSS JOIN entities e
    LEFT JOIN future_days f ON f.member = m AND f.step = s.step AND f.day > s.prev_date AND f.day <= s.date
    LEFT JOIN driver d ON d.cell = e.cell AND d.date = f.source GROUP BY m, s.step, s.date, e.entity, slope""")


def _band_sql(effect: str) -> str:
    return f"""SELECT step, date, {R('quantile_cont(c, 0.1)')} AS p10, {R('quantile_cont(c, 0.5)')} AS p50, {R('quantile_cont(c, 0.9)')} AS p90 FROM
    (SELECT member, step, date, avg(c) AS c FROM (SELECT member, step, date, entity, sum(effect) OVER (PARTITION BY member, entity ORDER BY step) AS c FROM {effect}) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


def _effect(spark, sf, edits, members):
    rows = analog.with_driver(spark, sf, "interval_mm")
    return scenario.interval_effect(analog.driver(spark, sf), analog.lines(rows), edits, members, analog.FIRST_YEAR, analog.LAST_YEAR)


@query("edit_effect", sql(["past_effect"], _band_sql("past_effect")))
def edit_effect(spark, sf):
    return rounded(scenario.cumulative_effect(_effect(spark, sf, EDITS, 1), analog.entities(spark, sf)))


@query("edit_effect_future", sql(["future_effect"], _band_sql("future_effect")))
def edit_effect_future(spark, sf):
    return rounded(scenario.cumulative_effect(_effect(spark, sf, FUTURE, 7), analog.entities(spark, sf)))


@query("edit_peak", sql(["future_effect"], f"SELECT * FROM ({_band_sql('future_effect')}) ORDER BY abs(p50) DESC, step LIMIT 1"))
def edit_peak(spark, sf):
    bands = scenario.cumulative_effect(_effect(spark, sf, FUTURE, 7), analog.entities(spark, sf))
    return scenario.peak(rounded(bands))


@query("edit_effect_entity", sql(["future_effect"], f"""SELECT entity, {R('quantile_cont(c, 0.5)')} AS effect FROM
(SELECT entity, member, sum(effect) AS c FROM future_effect WHERE step <= 3 GROUP BY 1, 2) GROUP BY 1"""))
def edit_effect_entity(spark, sf):
    return rounded(scenario.effect_at(_effect(spark, sf, FUTURE, 7), F.lit(3), analog.entities(spark, sf)))


@query("driver_context", sql(["slots", "smooth", "driver", "entities"], f"""WITH n AS (SELECT avg(s.total) AS normal, avg(d.total) AS seen FROM entities e JOIN
(SELECT k.cell, sum(smooth) AS total FROM slots k JOIN smooth USING (cell, slot) WHERE date BETWEEN DATE '1999-06-01' AND DATE '1999-08-31' GROUP BY 1) s USING (cell)
JOIN (SELECT cell, sum(mm) AS total FROM driver WHERE date BETWEEN DATE '1999-06-01' AND DATE '1999-08-31' GROUP BY 1) d USING (cell))
SELECT {R('normal')} AS normal_mm, {R('seen')} AS recorded_mm, {R('seen * 0.15')} AS added_mm, {R('CASE WHEN normal > 0.5 THEN seen * 0.15 / normal END')} AS added_vs_normal,
'south-west monsoon' AS season FROM n""".replace("WITH n AS", "SELECT * FROM (WITH n AS") + ")"))
def driver_context(spark, sf):
    daily = analog.driver(spark, sf)
    normals = sequences.smoothed_normals(daily, _in_train(spark, sf))
    return rounded(scenario.driver_context(daily, normals, analog.entities(spark, sf), EDITS[0], analog.LAST_YEAR))


define("november", ("with_driver", "lines"), """SELECT w.*, intercept + slope * interval_mm AS base, intercept + slope * (interval_mm * 0.8::DOUBLE) AS changed
    FROM with_driver w JOIN lines USING (season) WHERE season = 'NOV' AND season_year = 2000""")
_SUMMARY = f"""count(*) AS entities, {R('avg(changed)')} AS mean_change, {R('-avg(changed - base)')} AS level_vs_recorded, count(*) FILTER (WHERE changed > 0) AS falling,
    count(*) FILTER (WHERE changed <= 0) AS rising, count(*) FILTER (WHERE value_start + changed <= 60) AS waterlogged,
    count(*) FILTER (WHERE value_start + changed <= 60) - count(*) FILTER (WHERE value_start + base <= 60) AS waterlogged_vs_recorded"""


def _november(spark, sf, keep=None):
    rows = analog.with_driver(spark, sf, "interval_mm")
    return scenario.scenario_rows(rows, analog.lines(rows), 2000, -20.0, HELD, keep=keep)


@query("scenario_summary", sql(["november"], f"SELECT state, {_SUMMARY} FROM november GROUP BY 1"))
def scenario_summary(spark, sf):
    return rounded(scenario.scenario_summary(_november(spark, sf), ["state"], limit=60.0))


@query("scenario_one_state", sql(["november"], f"SELECT {_SUMMARY} FROM november WHERE state = 'ASIA'"))
def scenario_one_state(spark, sf):
    return rounded(scenario.scenario_summary(_november(spark, sf, F.col("state") == "ASIA"), limit=60.0))


@query("scenario_rows", sql(["november"], f"""SELECT entity, date, {R('changed')} AS changed, {R('base')} AS base, {R('value_start + changed')} AS after FROM november"""))
def scenario_rows(spark, sf):
    rows = _november(spark, sf)
    return rounded(rows.select("entity", "date", "changed", "base", (F.col("value_start") + F.col("changed")).alias("after")))


# ---------------------------------------------------------------- forecast
define("regular_x", ("regular_days", "driver"), """SELECT b.cell, year, season, r.date, r.prev_date, a.cum - b.cum AS interval_mm FROM regular_days r
    JOIN driver a ON a.date = r.date JOIN driver b ON b.date = r.prev_date AND b.cell = a.cell""")
define("steps", ("regular_x", "lines"), """SELECT cell, year, season, shift::INT AS shift, intercept + slope * (interval_mm * (1 + shift / 100.0::DOUBLE)) AS step
    FROM regular_x JOIN lines USING (season) CROSS JOIN (VALUES (-30), (-20), (-10), (0), (10), (20), (30)) v(shift)""")


def tables(spark, sf):
    """The step table, written out once for the jobs that look steps up."""
    rows = analog.with_driver(spark, sf, "interval_mm")
    spans = forecast.regular_intervals(analog.packed(spark, sf), analog.FIRST_YEAR, analog.LAST_YEAR)
    return cut_lineage(forecast.step_table(spans, analog.lines(rows)))


@query("regular_intervals", sql(["regular_x"], "SELECT cell, year, season, date, prev_date, interval_mm FROM regular_x"))
def regular_intervals(spark, sf):
    return forecast.regular_intervals(analog.packed(spark, sf), analog.FIRST_YEAR, analog.LAST_YEAR)


@query("step_table", sql(["steps"], f"SELECT cell, year, season, shift, {R('step')} AS step FROM steps"))
def step_table(spark, sf):
    return rounded(tables(spark, sf))


define("at_minus_13", ("steps",), """SELECT cell, year, season, sum(step * CASE shift WHEN -20 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END) AS step FROM steps
    WHERE shift IN (-20, -10) GROUP BY 1, 2, 3""")


@query("shift_interpolate", sql(["at_minus_13"], f"SELECT cell, year, season, {R('step')} AS step FROM at_minus_13"))
def shift_interpolate(spark, sf):
    return rounded(forecast.at_shift(tables(spark, sf), -13.0))


define("regular_residuals", ("campaign_readings", "entities", "steps"), """SELECT r.entity, e.grp, e.state, r.season, r.season_year, r.value - r.v AS delta, r.value - r.v - s.step AS residual, s.step AS expected FROM
    (SELECT *, q - lag(q) OVER w AS k, lag(value) OVER w AS v FROM (SELECT *, season_year * 4 + list_position(['JAN','MAY','AUG','NOV'], season) AS q FROM campaign_readings)
    WINDOW w AS (PARTITION BY entity ORDER BY date)) r JOIN entities e USING (entity) JOIN steps s ON s.cell = e.cell AND s.year = r.season_year AND s.season = r.season AND s.shift = 0 WHERE k = 1""")
def _rates_sql(first: int, last: int) -> str:
    return f"""WITH rr AS (SELECT * FROM regular_residuals WHERE season_year BETWEEN {first} AND {last}),
    m AS (SELECT entity, grp, state, season, avg(residual) AS v FROM rr GROUP BY 1, 2, 3, 4),
    g AS (SELECT grp, state, season, avg(v) AS v FROM m JOIN (SELECT grp, state FROM rr GROUP BY 1, 2 HAVING count(DISTINCT entity) >= 2) USING (grp, state) GROUP BY 1, 2, 3),
    s AS (SELECT state, season, avg(v) AS v FROM m JOIN (SELECT state FROM rr GROUP BY 1 HAVING count(DISTINCT entity) >= 2) USING (state) GROUP BY 1, 2)
    SELECT p.grp, p.state, q.season, coalesce(g.v, s.v, 0) AS rate FROM (SELECT DISTINCT grp, state FROM entities) p CROSS JOIN (SELECT unnest(['JAN','MAY','AUG','NOV']) AS season) q
    LEFT JOIN g ON g.grp = p.grp AND g.state = p.state AND g.season = q.season LEFT JOIN s ON s.state = p.state AND s.season = q.season"""


define("rates", ("regular_residuals", "entities"), _rates_sql(*HELD))


def regular_residuals(spark, sf, table=None):
    table = tables(spark, sf) if table is None else table
    rows = forecast.regular_changes(forecast.campaign_readings(analog.readings(spark, sf))).join(
        analog.entities(spark, sf).select("entity", "cell", "grp", "state"), "entity")
    steps = table.where("shift = 0").select("cell", F.col("year").alias("season_year"), "season", F.col("step").alias("expected"))
    return expected.residuals(rows.join(steps, ["cell", "season_year", "season"]))


def group_rates_of(spark, sf, table=None, years=HELD):
    rows = regular_residuals(spark, sf, table).where(F.col("season_year").between(*years))
    return cut_lineage(attribution.rates(rows, analog.entities(spark, sf)))


@query("regular_residuals", sql(["regular_residuals"], f"SELECT entity, season, season_year, {R('residual')} AS residual FROM regular_residuals"))
def regular_residuals_query(spark, sf):
    return rounded(regular_residuals(spark, sf).select("entity", "season", "season_year", "residual"))


@query("group_rates", sql(["rates"], f"SELECT grp, state, season, {R('rate', 5)} AS rate FROM rates"))
def group_rates(spark, sf):
    return rounded(group_rates_of(spark, sf), 5)


define("starts", ("readings", "entities", "at_minus_13", "rates"), """SELECT l.entity, e.cell, e.grp, e.state, depth, depth + coalesce(sum(step), 0) AS base, depth + coalesce(sum(step + rate), 0) AS base_trend FROM
    (SELECT entity, arg_max(value, date) AS depth, arg_max(season, date) AS season, arg_max(season_year, date) AS y FROM readings GROUP BY 1) l JOIN entities e USING (entity)
    LEFT JOIN (SELECT cell, a.season, step, grp, state, rate FROM at_minus_13 a JOIN rates r ON r.season = a.season WHERE year = 2001) s ON s.cell = e.cell AND s.grp = e.grp AND s.state = e.state
    AND (l.y < 2001 OR list_position(['JAN','MAY','AUG','NOV'], s.season) > list_position(['JAN','MAY','AUG','NOV'], l.season)) GROUP BY 1, 2, 3, 4, 5""")


@query("forecast_start", sql(["starts"], f"SELECT entity, {R('depth')} AS depth, {R('base', 5)} AS base, {R('base_trend', 5)} AS base_trend FROM starts"))
def forecast_start(spark, sf):
    table = tables(spark, sf)
    start = forecast.starts(analog.readings(spark, sf), forecast.at_shift(table, -13.0), analog.entities(spark, sf), analog.LAST_YEAR,
                            group_rates_of(spark, sf, table))
    return rounded(start.select("entity", "depth", "base", "base_trend"), 5, depth=6)


define("paths", ("starts", "at_minus_13", "rates"), """SELECT entity, depth, member, k AS step_no, year, season, base + sum(step) OVER w AS rain, base_trend + sum(step + rate) OVER w AS trend FROM
    (SELECT s.*, m::INT AS member, f.y AS year, a.season, ((f.y - 2002) * 4 + list_position(['JAN','MAY','AUG','NOV'], a.season))::INT AS k, a.step, r.rate FROM starts s
    CROSS JOIN range(0, 7) g(m) CROSS JOIN range(2002, 2009) f(y) JOIN at_minus_13 a ON a.cell = s.cell AND a.year = 1995 + (m + f.y - 2002) % 7
    JOIN rates r ON r.grp = s.grp AND r.state = s.state AND r.season = a.season) WINDOW w AS (PARTITION BY entity, member ORDER BY k)""")


def _start_and_table(spark, sf):
    table = tables(spark, sf)
    shifted, rate = forecast.at_shift(table, -13.0), group_rates_of(spark, sf, table)
    start = forecast.starts(analog.readings(spark, sf), shifted, analog.entities(spark, sf), analog.LAST_YEAR, rate)
    return start, shifted, rate


def _future(spark):
    return forecast.future_steps(spark, analog.FIRST_YEAR, analog.LAST_YEAR, 2008)


@query("replay_paths", sql(["paths"], f"""SELECT member, step_no, {R('avg(rain)', 5)} AS rain, {R('avg(trend)', 5)} AS rain_trend FROM paths GROUP BY 1, 2"""))
def replay_paths(spark, sf):
    start, shifted, rate = _start_and_table(spark, sf)
    return rounded(forecast.mean_paths(start, shifted, _future(spark), rate).drop("year", "season"), 5)


@query("replay_bands", sql(["paths"], "SELECT step_no, make_date(year, (CASE season WHEN 'JAN' THEN 1 WHEN 'MAY' THEN 5 WHEN 'AUG' THEN 8 ELSE 11 END)::BIGINT, 15) AS date, " + ", ".join(
    R(f"quantile_cont({c}, {p / 100})", 5) + f" AS {n}_p{p}" for c, n in (("rain", "rain"), ("trend", "trend")) for p in (10, 50, 90))
    + ", step_no / 4.0 > 5 AS beyond_tested_skill FROM (SELECT member, step_no, year, season, avg(rain) AS rain, avg(trend) AS trend FROM paths GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, year, season"))
def replay_bands(spark, sf):
    start, shifted, rate = _start_and_table(spark, sf)
    return rounded(forecast.bands(forecast.mean_paths(start, shifted, _future(spark), rate)), 5)


@query("forecast_entity", sql(["paths"], f"SELECT entity, {R('quantile_cont(rain, 0.5) - any_value(depth)', 5)} AS change FROM paths WHERE step_no = 28 GROUP BY 1"))
def forecast_entity(spark, sf):
    table = tables(spark, sf)
    shifted = forecast.at_shift(table, -13.0)
    start = forecast.starts(analog.readings(spark, sf), shifted, analog.entities(spark, sf), analog.LAST_YEAR)
    return rounded(forecast.entity_changes(start, shifted, _future(spark)), 5)


@query("history_means", sql(["readings", "entities"], f"""SELECT grp, season_year, season, {R('v', 5)} AS mean_value, n AS entities FROM (SELECT *, max(n) OVER (PARTITION BY grp) AS f FROM
(SELECT grp, season_year, season, avg(value) AS v, count(*) AS n FROM readings JOIN entities USING (entity) WHERE season_year >= 1996 GROUP BY 1, 2, 3)) WHERE n >= 0.5 * f"""))
def history_means(spark, sf):
    rows = analog.readings(spark, sf).join(analog.entities(spark, sf), "entity")
    return rounded(forecast.history_means(rows, ["grp"], 1996), 5)


def _backtest_sql(start: int, end: int, rates: bool) -> str:
    trend = ", ".join(R(f"avg({f}(h0 + rain + drift - value))", 5) + f" AS rain_trend_{n}" for f, n in (("abs", "mae"), ("", "bias"))) if rates else \
        "NULL::DOUBLE AS rain_trend_mae, NULL::DOUBLE AS rain_trend_bias"
    other = ", ".join(R(f"avg({f}({e} - value))", 5) + f" AS {p}_{n}" for p, e in (
        ("rain_only", "h0 + rain"), ("persistence", "h0"), ("own_trend", "h0 + own * t")) for f, n in (("abs", "mae"), ("", "bias")))
    return f"""SELECT ceil(t)::INT AS years_ahead, count(*) AS n, {other}, {trend} FROM (SELECT c.value, s.value AS h0, c.season_year + (p.p - 1) / 4.0 - {start}.75 AS t,
    coalesce(o.own, 0) AS own, (SELECT sum(step) FROM steps x WHERE x.shift = 0 AND x.cell = e.cell AND x.year * 4 + list_position(['JAN','MAY','AUG','NOV'], x.season)
      BETWEEN {start + 1} * 4 + 1 AND c.season_year * 4 + p.p) AS rain,
    (SELECT sum(rate * ((c.season_year - {start + 1})::INT + (list_position(['JAN','MAY','AUG','NOV'], z.season) <= p.p)::INT)) FROM {f'bt_rates_{start}' if rates else 'rates'} z WHERE z.grp = e.grp AND z.state = e.state) AS drift
    FROM campaign_readings c JOIN entities e USING (entity) CROSS JOIN LATERAL (SELECT list_position(['JAN','MAY','AUG','NOV'], c.season) AS p) p
    JOIN campaign_readings s ON s.entity = c.entity AND s.season_year = {start} AND s.season = 'NOV'
    LEFT JOIN (SELECT entity, CASE WHEN count(*) >= 6 THEN regr_slope(value, season_year + (list_position(['JAN','MAY','AUG','NOV'], season) - 1) / 4.0) ELSE 0 END AS own FROM campaign_readings
      WHERE season_year > {start - 4} AND season_year <= {start} GROUP BY 1) o ON o.entity = c.entity WHERE c.season_year BETWEEN {start + 1} AND {end}) GROUP BY 1"""


#: The years before a start whose residuals give its group rates.
RATE_YEARS = 4
for _start in (1998, 1999):
    define(f"bt_rates_{_start}", ("regular_residuals", "entities"), _rates_sql(_start - RATE_YEARS + 1, _start))


@query("backtest", sql(["campaign_readings", "entities", "steps", "rates"], _backtest_sql(1998, 2001, False)))
def backtest(spark, sf):
    table = tables(spark, sf).where("shift = 0")
    campaigns = forecast.campaign_readings(analog.readings(spark, sf))
    return rounded(forecast.backtest(campaigns, analog.entities(spark, sf), table, 1998, 2001), 5)


def _backtest_trend(spark, sf, start):
    table = tables(spark, sf)
    years = (start - RATE_YEARS + 1, start)
    campaigns = forecast.campaign_readings(analog.readings(spark, sf))
    return rounded(forecast.backtest(campaigns, analog.entities(spark, sf), table.where("shift = 0"), start, 2001,
                                     group_rates_of(spark, sf, table, years), years), 5)


@query("backtest_trend", sql(["campaign_readings", "entities", "steps", "bt_rates_1999"], _backtest_sql(1999, 2001, True)))
def backtest_trend(spark, sf):
    """The group trend of the years up to the start, judged on the years after it."""
    return _backtest_trend(spark, sf, 1999)


@query("backtest_trend_1998", sql(["campaign_readings", "entities", "steps", "bt_rates_1998"], _backtest_sql(1998, 2001, True)))
def backtest_trend_1998(spark, sf):
    return _backtest_trend(spark, sf, 1998)


@query("parity", sql(["regular_residuals", "scored"], f"""SELECT {R('quantile_cont(abs(r.expected - s.expected), 0.5)')} AS median, {R('quantile_cont(abs(r.expected - s.expected), 0.99)')} AS p99
FROM regular_residuals r JOIN scored s ON s.entity = r.entity AND s.season = r.season AND s.season_year = r.season_year"""))
def parity(spark, sf):
    """Step-table prediction of a regular step against the prediction at the date it was really read."""
    rebuilt = regular_residuals(spark, sf).select("entity", "season", "season_year", F.col("expected").alias("rebuilt"))
    stored = analog.scored(spark, sf).select("entity", "season", "season_year", F.col("expected").alias("stored"))
    return rounded(forecast.parity(rebuilt, stored, ["entity", "season", "season_year"], "rebuilt", "stored"))
