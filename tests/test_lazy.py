"""Plans of ranks, percentiles and point drivers are built without running anything but schema reads."""

import pytest

from stillwell.catalog import QUERIES, analog
from stillwell.operators import ranking
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["spearman", "average_ranks", "group_quartiles", "segment_profile", "masked_bilinear", "response_audit", "numeric_stats"])
def test_no_job_while_a_plan_is_built(spark, monkeypatch, name):
    read = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    monkeypatch.setattr(analog, "table", lambda spark, sf, t: read[t])
    context, group = spark.sparkContext, f"plan of {name}"
    context.setJobGroup(group, group)
    try:
        df = QUERIES[name](spark, SF)
        assert list(context.statusTracker().getJobIdsForGroup(group)) == []
        assert df.count() > 0
        assert list(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setJobGroup("", "")


def test_ranges_are_found_by_halving(spark):
    splits = F.array(*[F.lit(x) for x in (1.0, 2.0, 2.0, 5.0, 8.0, 8.0, 9.0)])
    rows = spark.createDataFrame([(x / 2,) for x in range(-2, 24)], "v double")
    for r in ranking.with_range(rows, "v", splits, 8).collect():
        assert r["_range"] == sum(s < r["v"] for s in (1.0, 2.0, 2.0, 5.0, 8.0, 8.0, 9.0))
