import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stillwell.operators import aggregates, cleaning, ranking, splits


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value and one group holds most of the rows."""
    rng = np.random.default_rng(0)
    x = np.where(rng.random(3000) < 0.34, 7.0, rng.normal(0, 50, 3000).round(1))
    y = x * 0.5 + rng.normal(0, 20, 3000).round(1)
    g = np.where(rng.random(3000) < 0.8, "hot", rng.choice(list("abc"), 3000))
    pdf = pd.DataFrame({"g": g, "x": x, "y": y})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("ranges", [1, 2, 16])
def test_percentiles_are_exact_for_any_number_of_ranges(skewed, ranges):
    pdf, df = skewed
    got = ranking.exact_percentiles(df, ["g"], "x", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ranges).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["p10", "p50", "p90"]].astype(float), np.percentile(part["x"], [10, 50, 90]))


@pytest.mark.parametrize("ranges", [1, 8])
def test_spearman_matches_pandas(skewed, ranges):
    pdf, df = skewed
    got = ranking.spearman(df, "x", "y", ranges=ranges).first()
    assert got["spearman"] == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank())) and got["rows"] == 3000


def test_average_ranks_match_pandas(skewed):
    pdf, df = skewed
    got = ranking.average_ranks(df, [], "x", "r", 8).toPandas().set_index("x")["r"]
    want = pdf.assign(r=pdf["x"].rank()).groupby("x")["r"].first()
    pd.testing.assert_series_equal(got.sort_index(), want, check_names=False)


def test_single_value_and_nulls(spark):
    df = spark.createDataFrame([(5.0,), (None,), (5.0,)], "x double")
    assert ranking.exact_percentiles(df, [], "x", {"m": 0.5}, 4).first()["m"] == 5.0


def test_hashed_order_is_a_permutation_and_repeats(spark):
    df = spark.createDataFrame([(i % 400,) for i in range(1000)], "k int")
    a = {r["k"]: r["place"] for r in ranking.hashed_order(df, "k", 42).collect()}
    assert sorted(a.values()) == list(range(400))
    assert a == {r["k"]: r["place"] for r in ranking.hashed_order(df.repartition(7), "k", 42).collect()}
    assert a != {r["k"]: r["place"] for r in ranking.hashed_order(df, "k", 43).collect()}


def test_split_counts_and_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(200) for _ in range(3)], "entity int")
    counts = {r["split"]: r["count"] for r in splits.entity_split(df, "entity").groupBy("split").count().collect()}
    assert counts == {"test": 30, "valid": 30, "train": 140}
    folds = [r["count"] for r in splits.fold_of(df, "entity").groupBy("fold").count().collect()]
    assert sorted(folds) == [40] * 5


@pytest.mark.parametrize("segment", [3, 1000])
def test_repeated_keys_are_numbered_in_file_order(spark, segment):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(50)], "row long, key string")
    got = ranking.segmented_row_number(df, ["key"], "row", "n", segment).where("key = 'hot'").orderBy("row").collect()
    assert [r["n"] for r in got] == list(range(len(got))) and {r["n_of"] for r in got} == {len(got)}


def test_every_member_of_a_repeated_coordinate_gets_a_suffix(spark):
    df = spark.createDataFrame([(0, 10.00001, 70.0), (1, 10.00002, 70.0), (2, 11.0, 70.0)], "row long, lat double, lon double")
    got = {r["row"]: r["well_uid"] for r in cleaning.coordinate_key(df, "lat", "lon", "row").collect()}
    assert got == {0: "10.0_70.0_0", 1: "10.0_70.0_1", 2: "11.0_70.0"}


def test_top_overlap(spark):
    a = spark.createDataFrame([(f"k{i}", float(i)) for i in range(10)], "k string, s double")
    b = spark.createDataFrame([(f"k{i}", float(-i)) for i in range(10)], "k string, s double")
    assert ranking.top_overlap(a, b, ["k"], "s", 6).first()["overlap"] == 2


def test_skewness_and_metrics(spark):
    x = np.random.default_rng(5).gamma(2, 3, 200)
    df = spark.createDataFrame([(float(v), float(v) * 0.9) for v in x], "y double, p double")
    assert aggregates.skewness(df, "y", "s").first()["s"] == pytest.approx(pd.Series(x).skew())
    m = aggregates.error_metrics(df, [], "y", "p").first()
    e = x * 0.9 - x
    assert m["mae"] == pytest.approx(np.abs(e).mean()) and m["r2"] == pytest.approx(1 - (e ** 2).sum() / ((x - x.mean()) ** 2).sum())
    flat = df.withColumn("y", F.lit(1.0))
    assert aggregates.error_metrics(flat, [], "y", "p").first()["r2"] is None


def test_subsample_is_exact_and_repeats(spark):
    df = spark.range(1000)
    a = {r["id"] for r in cleaning.exact_subsample(df, "id", 100, 1).collect()}
    assert len(a) == 100 and a == {r["id"] for r in cleaning.exact_subsample(df.repartition(9), "id", 100, 1).collect()}
