"""Fitted models through every job that scores: ridges whose closed form SQL can say, and tree ensembles it cannot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, encode, spatial, windows
from ..plans import attribution, expected, forecast, review, scenario, scoring
from ..session import kept
from . import analog
from .analog import define, sql
from .jobs import _SUMMARY, EDITS, FUTURE, HELD, _band_sql
from .registry import R, query, rounded
from .spatial import GRID, _bilinear_months, _monthly

INPUTS = ["interval_mm", "gap"]

define("ridge_facts", ("with_driver",), """SELECT count(*)::DOUBLE AS n, avg(delta) AS my, avg(interval_mm) AS m1, stddev_pop(interval_mm) AS s1,
    avg(gap) AS m2, stddev_pop(gap) AS s2 FROM with_driver WHERE split = 'train'""")
define("ridge_sums", ("with_driver", "ridge_facts"), """SELECT sum((interval_mm - m1) / s1 * (gap - m2) / s2) AS g12, sum((interval_mm - m1) / s1 * (delta - my)) AS c1,
    sum((gap - m2) / s2 * (delta - my)) AS c2 FROM with_driver CROSS JOIN ridge_facts WHERE split = 'train'""")
define("ridge_fit", ("ridge_facts", "ridge_sums"), """SELECT *, (c1 * (n + 1) - c2 * g12) / ((n + 1) ** 2 - g12 ** 2) AS w1, (c2 * (n + 1) - c1 * g12) / ((n + 1) ** 2 - g12 ** 2) AS w2
    FROM ridge_facts CROSS JOIN ridge_sums""")
_RIDGE = "my + w1 * ({x} - m1) / s1 + w2 * (gap - m2) / s2"


def ridge(spark, sf, rows=None):
    """A ridge on the interval driver and the days between readings, fitted on the training rows."""
    rows = analog.with_driver(spark, sf, "interval_mm") if rows is None else rows
    return scoring.fit_linear(rows, INPUTS, [], analog.is_train())


@query("ridge_weights", sql(["ridge_fit"], f"SELECT {R('my')} AS intercept, {R('w1')} AS interval_mm, {R('w2')} AS gap FROM ridge_fit"))
def ridge_weights(spark, sf):
    model = ridge(spark, sf)
    row = spark.range(1).select(F.lit(model.intercept).alias("intercept"), *[F.lit(model.weights[c]).alias(c) for c in INPUTS])
    return rounded(row)


_METRICS = f"""count(*) AS rows, {R('avg(abs(expected - delta))', 5)} AS mae, {R('sqrt(avg((expected - delta) ** 2))', 5)} AS rmse,
    {R('1 - avg((expected - delta) ** 2) / var_pop(delta)')} AS r2, {R('avg(expected - delta)', 5)} AS bias"""


@query("ridge_errors", sql(["with_driver", "ridge_fit"], f"""SELECT split, {_METRICS} FROM (SELECT w.*, {_RIDGE.format(x='interval_mm')} AS expected FROM with_driver w CROSS JOIN ridge_fit) GROUP BY 1"""))
def ridge_errors(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm")
    return rounded(aggregates.error_metrics(ridge(spark, sf, rows).score(rows), ["split"], "delta", "expected"), 5, r2=6)


define("ridge_november", ("with_driver", "ridge_fit"), f"""SELECT w.*, {_RIDGE.format(x='interval_mm')} AS base, {_RIDGE.format(x='(interval_mm * 0.8::DOUBLE)')} AS changed
    FROM with_driver w CROSS JOIN ridge_fit WHERE season = 'NOV' AND season_year = 2000""")


@query("scenario_summary_ridge", sql(["ridge_november"], f"SELECT state, {_SUMMARY} FROM ridge_november GROUP BY 1"))
def scenario_summary_ridge(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm")
    return rounded(scenario.scenario_summary(scenario.scenario_rows(rows, ridge(spark, sf, rows), 2000, -20.0, HELD), ["state"], limit=60.0))


@query("response_audit_ridge", sql(["with_driver", "ridge_fit"], f"""SELECT factor::DOUBLE AS factor, count(*) AS rows, {R('avg(d)')} AS mean, {R('avg(CASE WHEN factor > 1 THEN d > 1e-4 ELSE d < -1e-4 END::INT)')} AS wrong_way,
{R('quantile_cont(d, 0.1)')} AS p10, {R('quantile_cont(d, 0.9)')} AS p90 FROM (SELECT factor, ({_RIDGE.format(x='(interval_mm * factor)')}) - ({_RIDGE.format(x='interval_mm')}) AS d FROM with_driver CROSS JOIN ridge_fit
CROSS JOIN (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE)) f(factor)) GROUP BY 1"""))
def response_audit_ridge(spark, sf):
    rows = analog.with_driver(spark, sf, "interval_mm")
    return rounded(review.response(rows, ridge(spark, sf, rows)))


@query("step_table_ridge", sql(["regular_x", "ridge_fit"], f"""SELECT cell, year, season, shift::INT AS shift, {R(_RIDGE.format(x='(interval_mm * (1 + shift / 100.0::DOUBLE))'))} AS step FROM
(SELECT *, date - prev_date AS gap FROM regular_x) CROSS JOIN ridge_fit CROSS JOIN (VALUES (-30), (-20), (-10), (0), (10), (20), (30)) v(shift)"""))
def step_table_ridge(spark, sf):
    spans = forecast.regular_intervals(analog.packed(spark, sf), analog.FIRST_YEAR, analog.LAST_YEAR, ["gap"])
    return rounded(forecast.step_table(spans, ridge(spark, sf)))


for _name in ("past", "future"):
    define(f"{_name}_effect_ridge", (f"{_name}_effect", "lines", "ridge_fit", f"{_name}_steps"), f"""SELECT e.member, e.step, e.date, e.entity, e.effect / slope * w1 / s1 AS effect
        FROM {_name}_effect e JOIN {_name}_steps s ON s.step = e.step JOIN lines USING (season) CROSS JOIN ridge_fit""")


def _effect(spark, sf, model, edits, members):
    return scenario.model_effect(analog.driver(spark, sf), model, edits, members, analog.FIRST_YEAR, analog.LAST_YEAR)


@query("edit_effect_ridge", sql(["past_effect_ridge"], _band_sql("past_effect_ridge")))
def edit_effect_ridge(spark, sf):
    return rounded(scenario.cumulative_effect(_effect(spark, sf, ridge(spark, sf), EDITS, 1), analog.entities(spark, sf)))


@query("edit_effect_future_ridge", sql(["future_effect_ridge"], _band_sql("future_effect_ridge")))
def edit_effect_future_ridge(spark, sf):
    return rounded(scenario.cumulative_effect(_effect(spark, sf, ridge(spark, sf), FUTURE, 7), analog.entities(spark, sf)))


# ---------------------------------------------------------------- trees: checked against their own pipelines by tests
STEP_INPUTS = ["interval_mm", "gap", "mm_90d", "mm_365d"]


def boosted(spark, sf, rounds: int = 40):
    """Boosted trees on driver features, gap and season, as an expression."""
    rows = analog.with_driver(spark, sf, "interval_mm", "mm_90d", "mm_365d")
    stats = encode.saved(encode.numeric_stats(rows, STEP_INPUTS, analog.is_train()))
    model, _ = expected.fit_boosting(rows, STEP_INPUTS, ["season"], analog.is_train(), F.col("split") == "valid", rounds)
    return rows, scoring.compile_trees(model, stats)


@query("scenario_summary_boosted")
def scenario_summary_boosted(spark, sf):
    rows, model = boosted(spark, sf)
    return rounded(scenario.scenario_summary(scenario.scenario_rows(rows, model, 2000, -20.0, HELD), ["state"], limit=60.0), 4)


@query("response_audit_boosted")
def response_audit_boosted(spark, sf):
    rows, model = boosted(spark, sf)
    return rounded(review.response(rows, model), 4)


@query("edit_effect_boosted")
def edit_effect_boosted(spark, sf):
    _, model = boosted(spark, sf)
    return rounded(scenario.cumulative_effect(_effect(spark, sf, model, EDITS, 1), analog.entities(spark, sf)), 4)


# ---------------------------------------------------------------- group effects
def _group_fit_sql(rows: str, by: str) -> str:
    """Weights of a ridge on z1 and z2 with effects of ``grp`` for each ``by``, by Cramer's rule on the reduced equations."""
    def det(m):
        return " + ".join(f"({m[0][i]}) * (({m[1][j]}) * ({m[2][k]}) - ({m[1][k]}) * ({m[2][j]}))" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))
    a = [["a00", "a01", "a02"], ["a01", "a11", "a12"], ["a02", "a12", "a22"]]
    b = ["b0", "b1", "b2"]
    weights = ", ".join(f"({det([[b[r] if c == k else a[r][c] for c in range(3)] for r in range(3)])}) / ({det(a)}) AS w{k}" for k in range(3))
    return f"""SELECT {by}, {weights} FROM (SELECT {by}, sum(n - n * n / (n + 1)) AS a00, sum(s1 - n * s1 / (n + 1)) AS a01, sum(s2 - n * s2 / (n + 1)) AS a02,
        sum(g11 - s1 * s1 / (n + 1)) + 1 AS a11, sum(g12 - s1 * s2 / (n + 1)) AS a12, sum(g22 - s2 * s2 / (n + 1)) + 1 AS a22,
        sum(sy - n * sy / (n + 1)) AS b0, sum(c1 - s1 * sy / (n + 1)) AS b1, sum(c2 - s2 * sy / (n + 1)) AS b2 FROM {rows} GROUP BY {by})"""


_SUMS = """count(*)::DOUBLE AS n, sum(y) AS sy, sum(z1) AS s1, sum(z2) AS s2, sum(z1 * y) AS c1, sum(z2 * y) AS c2, sum(z1 * z1) AS g11, sum(z1 * z2) AS g12, sum(z2 * z2) AS g22"""
define("group_sums", ("with_driver", "ridge_facts"), f"""SELECT 'all' AS k, grp, {_SUMS} FROM (SELECT grp, delta AS y, (interval_mm - m1) / s1 AS z1, (gap - m2) / s2 AS z2
    FROM with_driver CROSS JOIN ridge_facts WHERE split = 'train') GROUP BY grp""")
define("group_fit", ("group_sums",), _group_fit_sql("group_sums", "k"))


@query("group_ridge", sql(["group_sums", "group_fit"], f"""SELECT grp, {R('(sy - w0 * n - w1 * s1 - w2 * s2) / (n + 1)')} AS effect, {R('w1')} AS interval_mm, {R('w2')} AS gap FROM group_sums CROSS JOIN group_fit"""))
def group_ridge(spark, sf):
    """Ridge with an effect per group, however many there are: the effects and the two weights."""
    rows = analog.with_driver(spark, sf, "interval_mm")
    model = scoring.fit_linear(rows, INPUTS, [], analog.is_train(), group="grp")
    return rounded(model.group_effects.select("grp", "effect", *[F.lit(model.weights[c]).alias(c) for c in INPUTS]))


# ---------------------------------------------------------------- rankings under each way to bring the driver to a place
define("method_months", ("corners", "nearest", "buffer_80", "monthly_sparse"), """SELECT 'bilinear' AS method, entity, month, sum(mm * w) AS mm FROM corners JOIN monthly_sparse USING (cell) GROUP BY 2, 3
    UNION ALL SELECT 'nearest', entity, month, mm FROM nearest JOIN monthly_sparse USING (cell)
    UNION ALL SELECT 'buffer', entity, month, avg(mm) FROM buffer_80 JOIN monthly_sparse USING (cell) GROUP BY 2, 3""")
define("method_sums", ("method_months",), """SELECT method, entity, month, CASE WHEN count(mm) OVER t = 3 THEN sum(mm) OVER t END AS mm_3m, CASE WHEN count(mm) OVER y = 12 THEN sum(mm) OVER y END AS mm_12m
    FROM method_months WINDOW t AS (PARTITION BY method, entity ORDER BY month ROWS 2 PRECEDING), y AS (PARTITION BY method, entity ORDER BY month ROWS 11 PRECEDING)""")
define("method_groups", ("method_sums", "readings", "entities"), """SELECT method, grp, season_year, season, avg(value) AS y, avg(mm_3m) AS mm_3m, avg(mm_12m) AS mm_12m
    FROM readings r JOIN entities USING (entity) JOIN method_sums m ON m.entity = r.entity AND m.month = date_trunc('month', r.date)::DATE
    GROUP BY 1, 2, 3, 4 HAVING avg(mm_3m) IS NOT NULL AND avg(mm_12m) IS NOT NULL""")
define("method_z", ("method_groups",), """SELECT *, (mm_3m - avg(mm_3m) OVER m) / stddev_pop(mm_3m) OVER m AS z1, (mm_12m - avg(mm_12m) OVER m) / stddev_pop(mm_12m) OVER m AS z2
    FROM method_groups WINDOW m AS (PARTITION BY method)""")
define("method_group_sums", ("method_z",), f"SELECT method, grp, {_SUMS} FROM method_z GROUP BY method, grp")
define("method_fit", ("method_group_sums",), _group_fit_sql("method_group_sums", "method"))
define("method_trends", ("method_z", "method_group_sums", "method_fit"), """SELECT method, grp, regr_slope(y - (w0 + w1 * z1 + w2 * z2 + e), season_year) AS trend FROM method_z z
    JOIN (SELECT method, grp, w0, w1, w2, (sy - w0 * n - w1 * s1 - w2 * s2) / (n + 1) AS e FROM method_group_sums JOIN method_fit USING (method)) f USING (method, grp)
    GROUP BY 1, 2 HAVING count(DISTINCT season_year) >= 5""")


def method_trends(spark, sf):
    """Residual trend of each group under each way to bring the monthly driver to an entity's place.

    Months are worked out once a place, and readings are summed by place, group and month before they meet them.
    """
    months = kept(_monthly(spark, sf))                         # a row per cell and month
    people, grid = spatial.with_place(analog.entities(spark, sf)), analog.cells(spark, sf)
    places = spatial.distinct_places(people)
    nearest = spatial.nearest_cell(places, grid, **GRID).select("place", "cell").join(months, "cell")
    near = spatial.cells_in_radius(places, "place", grid, 80.0, **GRID).join(months, "cell").groupBy("place", "month").agg(F.avg("mm").alias("mm"))
    parts = [t.select(F.lit(n).alias("method"), "place", "month", "mm")
             for n, t in (("bilinear", _bilinear_months(spark, sf, places, "place", months)), ("nearest", nearest), ("buffer", near))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("_who", F.struct("method", "place"))
    sums = windows.rolling_rows(every, "mm", [3, 12], "_who").drop("_who", "mm")
    read = analog.readings(spark, sf).withColumn("month", F.trunc("date", "month")).join(people.select("entity", "grp", "place"), "entity")
    met = read.groupBy("place", "grp", "month", "season_year", "season").agg(
        F.sum("value").alias("_sum"), F.count("value").alias("_known"), F.count(F.lit(1)).alias("_n")).join(sums, ["place", "month"])

    def mean(x: str):
        """Mean over the readings: each row stands for ``_n`` of them."""
        return F.try_divide(F.sum(F.col("_n") * F.col(x)), F.sum(F.when(F.col(x).isNotNull(), F.col("_n")))).alias(x)

    # read by every step of the fit; a row per way, group and season
    table = kept(met.groupBy("method", "grp", "season_year", "season").agg(
        F.try_divide(F.sum("_sum"), F.sum("_known")).alias("value"), mean("mm_3m"), mean("mm_12m")))
    fitted = scoring.expected_by(table, "method", ["mm_3m", "mm_12m"], "grp", target="value")
    return attribution.residual_trend(expected.residuals(fitted, "value"), ["method", "grp"], 5)


@query("method_trends", sql(["method_trends"], f"SELECT method, grp, {R('trend', 5)} AS trend FROM method_trends"))
def method_trends_query(spark, sf):
    return rounded(method_trends(spark, sf).select("method", "grp", "trend"), 5)


@query("method_rankings", sql(["method_trends"], f"""SELECT a.method AS first, b.method AS second, {R('corr(a.r, b.r)')} AS spearman, count(*) AS common, count(*) FILTER (WHERE a.p <= 10 AND b.p <= 10) AS top10 FROM
(SELECT *, rank() OVER (PARTITION BY method ORDER BY trend) AS r, row_number() OVER (PARTITION BY method ORDER BY trend DESC, grp) AS p FROM method_trends) a JOIN
(SELECT *, rank() OVER (PARTITION BY method ORDER BY trend) AS r, row_number() OVER (PARTITION BY method ORDER BY trend DESC, grp) AS p FROM method_trends) b
ON a.grp = b.grp AND a.method < b.method GROUP BY 1, 2"""))
def method_rankings(spark, sf):
    """How far the ranking of groups depends on the way: one row per pair of ways."""
    return rounded(review.ranking_agreement(method_trends(spark, sf), "method", ["grp"], "trend", 10))
