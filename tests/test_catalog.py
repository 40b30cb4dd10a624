import inspect
import os

import pytest

import oracle
from stillwell.catalog import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
# every query is compared by tests/oracle.py; these stand for each kind here
CHECKED = ["delta_target", "interval_sum", "trailing_sums", "feature_table", "weekly_sequence", "encode_category", "grouped_split",
           "dup_keys", "crosstab_margins", "as_of_lookup", "pack_grid", "within_corr", "lag1_autocorr", "rolling_months", "masked_bilinear",
           "polygon_or_nearest", "place_search", "pressure_rank", "rank_agreement", "edit_effect_future", "replay_bands", "backtest_trend",
           "backtest_trend_1998", "bilinear_features", "affected_steps", "exact_subsample", "within_spread", "patches", "season_mean_model",
           "fold_cross_validation"]
# ALL_QUERIES=1 compares the rest too
if os.environ.get("ALL_QUERIES"):
    CHECKED = sorted(ORACLE)

needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SMALL)


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SMALL), con, ORACLE[name]) == []


@needs_data
def test_the_comparison_sees_differences(spark, con):
    df = QUERIES["percent_missing"](spark, SMALL)
    sql = ORACLE["percent_missing"]
    assert oracle.compare(df, con, sql) == []
    assert oracle.compare(df, con, f"SELECT cell, missing_pct + 0.000001 AS missing_pct, rows FROM ({sql})")
    assert oracle.compare(df, con, f"SELECT * FROM ({sql}) LIMIT 3")
    assert oracle.compare(df, con, f"SELECT cell, missing_pct, rows::INT AS rows FROM ({sql})")
    assert oracle.compare(df, con, f"SELECT cell, rows FROM ({sql})")


def test_every_key_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 150


@needs_data
@pytest.mark.parametrize("name", ["feature_table", "pressure_cube", "masked_bilinear", "bilinear_features", "season_mean_model", "fold_cross_validation", "sequence_by_week", "point_in_polygon", "radius_mean",
                                  "group_quartiles", "as_of_lookup"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "MapInPandas"):
        assert word not in plan, (name, word)


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["column_pruned_scan"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_queries_have_names_of_their_own():
    assert all(not n.startswith("op") and "pipeline" not in n for n in QUERIES)
    assert all(len(inspect.signature(f).parameters) == 2 for f in QUERIES.values())
