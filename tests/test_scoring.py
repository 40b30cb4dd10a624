import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwell.operators import encode
from stillwell.plans import expected, review, scoring
from test_models import is_train, rows  # noqa: F401  (a fixture)


def gap(a, b, spark_rows):
    """Largest difference of two columns of scored rows."""
    return spark_rows.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("m")).first()["m"]


def test_linear_agrees_with_the_pipeline_and_the_closed_form(rows):
    pdf, df = rows
    model = scoring.fit_linear(df, ["a", "b"], ["season"], is_train(), alpha=50.0)
    fitted, table = expected.fit_ridge(df, ["a", "b"], ["season"], is_train(), alpha=50.0)
    other = fitted.transform(table).select("delta", F.col("expected").alias("other"))
    scored = model.score(df).join(other, "delta")
    assert scored.count() == df.count() and gap("expected", "other", scored) < 1e-4
    assert model.needs == ["a", "b", "season"]


def test_changed_columns_take_the_place_of_recorded_ones(rows):
    _, df = rows
    model = scoring.fit_linear(df, ["a", "b"], ["season"], is_train())
    moved = model.score(model.score(df, "base"), "new", {"a": F.col("a") + 2, "season": F.lit("NEW")})
    again = model.score(model.score(df, "base").withColumn("a", F.col("a") + 2).withColumn("season", F.lit("NEW")), "new")
    assert moved.agg(F.sum("new")).first()[0] == pytest.approx(again.agg(F.sum("new")).first()[0])


def grouped(spark, groups, per_group, seed=1):
    rng = np.random.default_rng(seed)
    n = groups * per_group
    pdf = pd.DataFrame({"g": np.repeat(np.arange(groups), per_group), "a": rng.normal(2, 1, n), "b": rng.normal(0, 3, n)})
    pdf["delta"] = pdf["a"] - 0.5 * pdf["b"] + rng.normal(0, 1, groups)[pdf["g"]] + rng.normal(0, 0.1, n)
    return pdf, spark.createDataFrame(pdf)


def test_group_effects_equal_the_dense_solution(spark):
    pdf, df = grouped(spark, 12, 9)
    df = df.union(spark.createDataFrame([(None, 1.0, 2.0, 3.0), (None, 0.0, 1.0, -1.0)], df.schema))
    pdf = pd.concat([pdf, pd.DataFrame({"g": [99, 99], "a": [1.0, 0.0], "b": [2.0, 1.0], "delta": [3.0, -1.0]})])
    model = scoring.fit_linear(df, ["a", "b"], [], F.lit(True), alpha=2.0, group="g")
    x = pdf[["a", "b"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    hot = (pdf["g"].to_numpy()[:, None] == np.unique(pdf["g"])).astype(float)
    full = np.hstack([np.ones((len(x), 1)), x, hot])
    penalty = 2.0 * np.eye(full.shape[1])
    penalty[0, 0] = 0
    w = np.linalg.solve(full.T @ full + penalty, full.T @ pdf["delta"].to_numpy())
    got = sorted((r["delta"], r["expected"]) for r in model.score(df).collect())
    want = sorted(zip(pdf["delta"], full @ w))
    np.testing.assert_allclose(got, want, atol=1e-9)
    unseen = model.score(spark.createDataFrame([(-7, 2.0, 0.0, 0.0)], df.schema)).first()["expected"]
    plain = model.column()
    assert unseen == pytest.approx(spark.createDataFrame([(-7, 2.0, 0.0, 0.0)], df.schema).select(plain.alias("p")).first()["p"])


def test_ten_thousand_groups(spark):
    pdf, df = grouped(spark, 10_000, 4)
    model = scoring.fit_linear(df, ["a", "b"], [], F.lit(True), group="g")
    error = model.score(df).agg(F.avg(F.abs(F.col("expected") - F.col("delta"))).alias("e")).first()["e"]
    assert model.group_effects.count() == 10_000 and error < 0.35
    assert model.weights["a"] / pdf["a"].std(ddof=0) == pytest.approx(1, abs=0.02)


def test_each_method_is_fitted_alone(spark):
    one, df = grouped(spark, 6, 8, 1)
    two, other = grouped(spark, 6, 8, 2)
    both = df.withColumn("m", F.lit("x")).union(other.withColumn("m", F.lit("y")))
    got = scoring.expected_by(both, "m", ["a", "b"], "g").select("m", "delta", "expected")
    for name, part in (("x", df), ("y", other)):
        alone = scoring.fit_linear(part, ["a", "b"], [], F.lit(True), group="g").score(part).select("delta", F.col("expected").alias("alone"))
        assert gap("expected", "alone", got.where(F.col("m") == name).join(alone, "delta")) < 1e-9


@pytest.mark.parametrize("kind", ["boosting", "forest"])
def test_trees_agree_with_their_pipeline(rows, kind):
    _, df = rows
    stats = encode.saved(encode.numeric_stats(df, ["a", "b"], is_train()))
    if kind == "boosting":
        fitted, table = expected.fit_boosting(df, ["a", "b"], ["season"], is_train(), F.col("split") == "valid", rounds=12, depth=4)
    else:
        fitted, table = expected.fit_forest(df, ["a", "b"], is_train(), trees=7, depth=6), expected.encoded(df, ["a", "b"], is_train())
    model = scoring.compile_trees(fitted, stats)
    scored = model.score(df, "mine").join(fitted.transform(table).select("delta", "expected"), "delta")
    assert scored.count() == df.count() and gap("mine", "expected", scored) < 1e-9
    if kind == "boosting":
        assert any(n["m"] for n in model.nodes)                # a split by category was met
    plan = model.score(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan


def test_a_forest_of_leaves(rows):
    _, df = rows
    fitted = expected.fit_forest(df, ["a", "b"], is_train(), trees=2, depth=0)
    model = scoring.compile_trees(fitted, encode.saved(encode.numeric_stats(df, ["a", "b"], is_train())))
    assert model.depth == 0 and model.score(df).agg(F.count_distinct("expected")).first()[0] == 1


def test_any_model_through_the_audit(rows, spark):
    _, df = rows
    lines = spark.createDataFrame([(s, 1.0, -2.0) for s in ("JAN", "MAY")], "season string, intercept double, slope double")
    seen = df.withColumn("interval_mm", F.col("a"))
    line = {r["factor"]: r for r in review.response(seen, lines).collect()}
    own = scoring.Linear(1.0, {"interval_mm": scoring.Numeric(0.0, 0.0, 1.0)}, {"interval_mm": -2.0})
    linear = {r["factor"]: r for r in review.response(seen.where("season in ('JAN', 'MAY')"), own).collect()}
    assert line.keys() == linear.keys()
    for factor in line:
        assert line[factor]["mean"] == pytest.approx(linear[factor]["mean"]) and line[factor]["rows"] == linear[factor]["rows"]


def test_scaled_names_only_what_grows_with_the_driver():
    class Model:
        needs = ["interval_mm", "mm_90d", "wet_days", "gap", "season", "anom_season_mm", "max_day_mm"]
    assert list(scoring.scaled(Model, F.lit(2.0))) == ["interval_mm", "mm_90d", "max_day_mm"]


def test_rankings_of_methods(spark):
    rows = [("x", g, float(g)) for g in range(6)] + [("y", g, float(-g)) for g in range(6)] + [("z", g, float(g // 2)) for g in range(6)] + [("x", 9, 5.0)]
    got = {(r["first"], r["second"]): r for r in review.ranking_agreement(spark.createDataFrame(rows, "m string, g long, s double"), "m", ["g"], "s", 2).collect()}
    assert got["x", "y"]["spearman"] == pytest.approx(-1) and got["x", "y"]["common"] == 6 and got["x", "y"]["top2"] == 0
    assert got["x", "z"]["spearman"] == pytest.approx(pd.Series(range(6)).corr(pd.Series([0, 0, 1, 1, 2, 2]).rank()))
    assert got["x", "z"]["top2"] == 2
