import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwell.operators import aggregates
from stillwell.plans import expected


def is_train():
    return F.col("split") == "train"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    n = 1500
    pdf = pd.DataFrame({"a": rng.normal(5, 3, n), "b": rng.gamma(2, 2, n), "season": rng.choice(["JAN", "MAY", "AUG"], n)})
    pdf.loc[rng.random(n) < 0.1, "b"] = np.nan
    pdf.loc[:4, "season"] = "ODD"                              # too rare for its own level
    pdf["delta"] = 0.8 * pdf["a"] - 0.3 * pdf["b"].fillna(3) + (pdf["season"] == "MAY") * 2 + rng.normal(0, 0.5, n)
    pdf["split"] = rng.choice(["train", "valid", "test"], n, p=[.6, .2, .2])
    pdf.loc[:4, "split"] = "train"
    pdf.loc[5, ["season", "split"]] = ["NEW", "test"]          # never seen in training
    df = spark.createDataFrame(pdf).withColumn("b", F.nanvl("b", F.lit(None).cast("double"))).cache()
    return pdf, df


def test_ridge_equals_the_closed_form(rows):
    pdf, df = rows
    model, table = expected.fit_ridge(df, ["a", "b"], ["season"], is_train(), alpha=50.0)
    got = model.transform(table).select("a", "delta", "expected").toPandas().sort_values("delta")["expected"].to_numpy()
    tr = (pdf["split"] == "train").to_numpy()
    x = pdf[["a", "b"]].to_numpy()
    x = np.where(np.isnan(x), np.nanmedian(x[tr], axis=0), x)
    x = (x - x[tr].mean(0)) / x[tr].std(0)
    hot = np.stack([(pdf["season"] == s).to_numpy(float) for s in ("ODD", "AUG", "JAN", "MAY")], 1)
    x, y = np.hstack([x, hot]), pdf["delta"].to_numpy()
    xm, ym = x[tr].mean(0), y[tr].mean()
    w = np.linalg.solve((x[tr] - xm).T @ (x[tr] - xm) + 50 * np.eye(x.shape[1]), (x[tr] - xm).T @ (y[tr] - ym))
    want = ((x - xm) @ w + ym)[np.argsort(y)]
    np.testing.assert_allclose(got, want, atol=1e-4)


def test_boosting_beats_the_season_mean_on_held_out_rows(rows):
    _, df = rows
    model, table = expected.fit_boosting(df, ["a", "b"], ["season"], is_train(), F.col("split") == "valid", rounds=25, depth=3)
    boosted = aggregates.error_metrics(model.transform(table).where("split = 'test'"), [], "delta", "expected").first()
    plain = aggregates.error_metrics(expected.season_mean(df, is_train()).where("split = 'test'"), [], "delta", "expected").first()
    assert boosted["r2"] > 0.8 > plain["r2"]


def test_forest_finds_the_column_that_matters(rows, spark):
    _, df = rows
    model = expected.fit_forest(df, ["a", "b"], is_train(), trees=10, depth=5)
    top = expected.importances(model, ["a", "b"], spark, top=1).collect()
    assert len(top) == 1 and top[0]["feature"] == "a"


def test_cross_validation_scores_every_row_once(rows):
    _, df = rows
    folded = df.withColumn("fold", F.pmod(F.hash("delta"), F.lit(5)))

    def fit_predict(train, held):
        return held.withColumn("expected", train.agg(F.avg("delta").alias("m")).scalar())

    scored = expected.cross_validate(folded, "fold", 5, fit_predict)
    assert scored.count() == df.count()
