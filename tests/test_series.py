"""Range maxima, the two-level carry and level numbering against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwell.operators import encode, series
from stillwell.plans import features

DAY = dt.date(2000, 1, 1)


def test_largest_day_of_any_span(spark):
    rng = np.random.default_rng(4)
    mm = rng.gamma(0.3, 20, 137).round(1)
    daily = spark.createDataFrame([(1, DAY + dt.timedelta(k), float(v)) for k, v in enumerate(mm)], "cell int, date date, mm double")
    packed = features.pack_driver(daily)
    spans = [(a, b) for a in range(-4, 142, 3) for b in range(a, 145, 5)] + [(k, k + n) for n in (1, 2, 3, 4, 7, 8, 9, 64, 128, 137) for k in (-1, 0, 5)]
    asked = spark.createDataFrame([(1, a, b, DAY + dt.timedelta(a), DAY + dt.timedelta(b)) for a, b in spans], "cell int, a int, b int, after date, until date")
    plan = asked.join(packed, "cell").select("a", "b", series.span_max("peaks", F.col("after"), F.col("until")).alias("m"))
    for r in plan.collect():
        inside = mm[max(r["a"] + 1, 0):max(r["b"] + 1, 0)]
        assert r["m"] == (inside.max() if len(inside) else None), r


def test_maxima_of_one_day_and_of_unknown_days(spark):
    row = spark.createDataFrame([([3.0],), ([None, 2.0, None, None, 1.0],)], "v array<double>").select(series.range_maxima(F.col("v")).alias("p")).collect()
    assert row[0]["p"] == [[3.0]]
    assert row[1]["p"] == [[None, 2.0, None, None, 1.0], [2.0, 2.0, None, 1.0, 1.0], [2.0, 2.0, 1.0, 1.0, 1.0]]


@pytest.mark.parametrize("key", [[], ["k"]])
@pytest.mark.parametrize("segment", [1, 7, 10_000])
def test_carry_over_segments(spark, key, segment):
    rng = np.random.default_rng(8)
    events = sorted({(int(rng.integers(2)) if key else 0, int(rng.integers(400))) for _ in range(25)})
    asked = [(int(rng.integers(2)) if key else 0, int(rng.integers(-20, 420)), n) for n in range(200)]
    left = spark.createDataFrame([(k, DAY + dt.timedelta(d), n) for k, d, n in asked], "k int, day date, n int")
    right = spark.createDataFrame([(k, DAY + dt.timedelta(d), float(d)) for k, d in events], "k int, at date, v double")
    if not key:
        left, right = left.drop("k"), right.drop("k")
    got = {r["n"]: r["v"] for r in series.latest_at_or_before(left, right, key, "day", "at", ["v"], segment).collect()}
    for k, d, n in asked:
        known = [e for g, e in events if g == k and e <= d]
        assert got[n] == (float(max(known)) if known else None)


def test_no_key_is_spread_over_tasks(spark):
    days = spark.range(4000).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("day"))
    events = days.where("day(day) = 1").select(F.col("day").alias("at"), F.month("day").alias("v"))
    plan = series.latest_at_or_before(days, events, [], "day", "at", ["v"])
    assert plan.where("v <> month(day)").count() == 0
    windows = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert windows and all("_segment" in x for x in windows)


@pytest.mark.parametrize("ranges", [1, 2, 8])
def test_levels_are_numbered_in_order(spark, ranges):
    rng = np.random.default_rng(2)
    names = sorted({"".join(rng.choice(list("abcé"), int(rng.integers(1, 7)))) for _ in range(900)})
    rows = spark.createDataFrame([(n, True) for n in names * 2] + [("zz", False), (None, True)], "c string, train boolean")
    got = {r["c"]: r["code"] for r in encode.category_levels(rows, "c", F.col("train"), ranges).collect()}
    assert got == {n: k for k, n in enumerate(sorted([*names, "unknown"], key=lambda s: s.encode()))}


def test_a_million_levels(spark):
    rows = spark.range(1_000_000).select(F.sha1(F.col("id").cast("string")).alias("c"))
    levels = encode.category_levels(rows, "c", F.lit(True), 8)
    ends = levels.agg(F.min("code").alias("a"), F.max("code").alias("b"), F.count_distinct("code").alias("n")).first()
    assert tuple(ends) == (0, 999_999, 1_000_000)
    assert levels.where("code < 500000").agg(F.max("c")).first()[0] < levels.where("code >= 500000").agg(F.min("c")).first()[0]
    largest = levels.groupBy(F.floor(F.col("code") / 1)).count().agg(F.max("count")).first()[0]
    assert largest == 1
    spark.catalog.clearCache()
