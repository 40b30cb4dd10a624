"""Checks on models: weights, error correlation, response to the driver, spatial methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import numbers
from ..functions.constants import RESPONSE_FACTORS, WRONG_WAY_TOLERANCE
from ..operators import aggregates, ranking, windows
from . import scoring


def ensemble_weights(rows: DataFrame, observed: str, first: str, second: str, steps: int = 20) -> DataFrame:
    """R2 of ``w * first + (1 - w) * second`` for w = 0, 0.05, ... 1.

    The squared error is a quadratic in ``w``, so three sums over the rows serve every weight.
    """
    a, b = F.col(first) - F.col(observed), F.col(second) - F.col(observed)
    sums = rows.agg(F.sum(a * a).alias("_aa"), F.sum(a * b).alias("_ab"), F.sum(b * b).alias("_bb"),
                    (F.var_pop(observed) * F.count(F.lit(1))).alias("_ss"))
    each = sums.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = F.col("_k") / F.lit(float(steps))
    error = w * w * F.col("_aa") + 2 * w * (1 - w) * F.col("_ab") + (1 - w) * (1 - w) * F.col("_bb")
    return each.select(w.alias("weight"), (1 - error / F.nullif(F.col("_ss"), F.lit(0.0))).alias("r2"))


def best_weight(weights: DataFrame) -> DataFrame:
    return weights.orderBy(F.desc("r2"), "weight").limit(1)


def error_correlation(rows: DataFrame, observed: str, first: str, second: str) -> DataFrame:
    return rows.agg(numbers.correlation(F.col(observed) - F.col(first), F.col(observed) - F.col(second)).alias("corr"),
                    F.count(F.lit(1)).alias("rows"))


def response(rows: DataFrame, model, factors: list[float] | None = None) -> DataFrame:
    """How the expected change moves when the driver is scaled: mean, 10 % and 90 %, and the wrong-way share.

    More driver must not predict a larger fall, nor less of it a smaller one. ``model`` is one of ``scoring`` or a
    table of season lines; every feature that grows with the driver is scaled.
    """
    model = scoring.as_model(model)
    each = rows.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors or RESPONSE_FACTORS])))
    base = model.score(each, "_base")
    moved = model.score(base, "_new", scoring.scaled(model, F.col("factor"))).withColumn("_d", F.col("_new") - F.col("_base"))
    wrong = F.when(F.col("factor") > 1, F.col("_d") > WRONG_WAY_TOLERANCE).otherwise(F.col("_d") < -WRONG_WAY_TOLERANCE)
    means = moved.groupBy("factor").agg(F.count(F.lit(1)).alias("rows"), F.avg("_d").alias("mean"),
                                        F.avg(wrong.cast("double")).alias("wrong_way"))
    spread = ranking.exact_percentiles(moved, ["factor"], "_d", {"p10": 0.1, "p90": 0.9})
    return means.join(F.broadcast(spread), "factor")          # one row per factor


def skill_over(rows: DataFrame, observed: str, better: str, baseline: str) -> DataFrame:
    """R2 of a model, of a baseline, and the difference."""
    a, b = F.col(better) - F.col(observed), F.col(baseline) - F.col(observed)
    v = F.nullif(F.var_pop(observed), F.lit(0.0))
    return rows.agg((1 - F.avg(a * a) / v).alias("r2"), (1 - F.avg(b * b) / v).alias("r2_baseline"),
                    ((F.avg(b * b) - F.avg(a * a)) / v).alias("added"))


def train_share(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg((F.col("split") == "train").cast("double")).alias("train_share"),
                                   F.count(F.lit(1)).alias("rows"))


def compare_methods(base: DataFrame, others: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Correlation and mean absolute difference of each method against the base one, over rows known to both."""
    out = None
    for name, table in others.items():
        both = base.select(*keys, F.col(value).alias("_a")).join(table.select(*keys, F.col(value).alias("_b")), keys)
        both = both.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        gap = F.avg(F.abs(F.col("_b") - F.col("_a")))
        row = both.agg(F.count(F.lit(1)).alias("rows"), numbers.correlation(F.col("_b"), F.col("_a")).alias("corr"), gap.alias("mae"),
                       (gap / F.nullif(F.avg("_a"), F.lit(0.0)) * 100).alias("mae_pct")).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def naive_driver_errors(yearly: DataFrame, value: str, keys: list[str], year: str, first: int, last: int) -> DataFrame:
    """Mean absolute error of last year's value and of the mean of all earlier years."""
    both = windows.past_mean_and_last(yearly, value, keys, year).where(F.col(year).between(first, last))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col(value) - F.col("past_mean"))).alias("climatology_mae"),
                    F.avg(F.abs(F.col(value) - F.col("previous"))).alias("persistence_mae"))


def monthly_features(monthly: DataFrame, value: str = "mm") -> DataFrame:
    """Rolling sums and the z-score within the calendar month of the 12-month sum."""
    rolled = windows.rolling_rows(monthly, value, [3, 6, 12, 24, 36])
    return windows.z_score(rolled.withColumn("cal_month", F.month("month")), f"{value}_12m", ["cell", "cal_month"],
                           f"{value}_12m_z")


def fold_metrics(rows: DataFrame, fold: str) -> DataFrame:
    """Error metrics of each held-out fold, and their plain mean as fold -1."""
    per = aggregates.error_metrics(rows, [fold], "delta", "expected")
    mean = per.agg(F.lit(-1).alias(fold), F.sum("rows").alias("rows"),
                   *[F.avg(c).alias(c) for c in ("mae", "rmse", "r2", "bias")])
    return per.unionByName(mean)


def ranking_agreement(rows: DataFrame, by: str, keys: list[str], score: str, top: int) -> DataFrame:
    """Agreement of the rankings that each value of ``by`` gives the keys: one row per pair of values.

    Rank correlation (ties share their mean place) over the keys that every value of ``by`` ranks, and how many of the
    ``top`` highest they share. There is one row per key and value, and the keys of one value are ranked together, so
    keys are groups such as districts, not entities.
    """
    scores = F.map_from_entries(F.collect_list(F.struct(by, score)))
    every = rows.agg(F.count_distinct(by)).scalar()
    known = rows.where(F.col(score).isNotNull()).groupBy(*keys).agg(scores.alias("_all")).where(F.size("_all") == every)
    each = known.select(*keys, F.explode("_all").alias(by, score))
    over = W.partitionBy(by)
    place = F.rank().over(over.orderBy(F.col(score))) + (F.count(F.lit(1)).over(W.partitionBy(by, score)) - 1) / 2
    best = F.row_number().over(over.orderBy(F.desc(score), *keys)) <= top
    ranked = each.select(*keys, by, place.alias("_rank"), best.alias("_top"))
    both = ranked.select(*keys, F.col(by).alias("first"), F.col("_rank").alias("_a"), F.col("_top").alias("_ta")).join(
        ranked.select(*keys, F.col(by).alias("second"), F.col("_rank").alias("_b"), F.col("_top").alias("_tb")), keys)
    return both.where("first < second").groupBy("first", "second").agg(
        numbers.correlation(F.col("_a"), F.col("_b")).alias("spearman"), F.count(F.lit(1)).alias("common"),
        F.count_if(F.col("_ta") & F.col("_tb")).alias(f"top{top}"))
