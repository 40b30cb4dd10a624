"""Expected change given the driver. Every model adds an ``expected`` column, so the jobs after it do not care which.

The closed-form models are one grouped aggregate; the fitted ones are ``pyspark.ml`` pipelines.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import SEED
from ..llm.shared import staged
from ..operators import encode


def zero(rows: DataFrame) -> DataFrame:
    return rows.withColumn("expected", F.lit(0.0))


def season_mean(rows: DataFrame, train: Column, target: str = "delta") -> DataFrame:
    """Training mean of the row's season; a season without training rows gets the overall training mean."""
    sums = rows.where(train).groupBy("season").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    # at most one entry per season of the year
    by_season = sums.agg(F.map_from_entries(F.collect_list(F.struct("season", F.try_divide("_s", F.col("_n"))))).alias("m")).scalar()
    overall = sums.agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("m")).scalar()
    return rows.withColumn("expected", F.coalesce(by_season[F.col("season")], overall))


def season_line(rows: DataFrame, train: Column, x: str = "interval_mm", target: str = "delta") -> DataFrame:
    """Intercept and slope of the change on the interval driver, per season: at most four rows."""
    return rows.where(train).groupBy("season").agg(
        F.regr_intercept(F.col(target), F.col(x)).alias("intercept"), F.regr_slope(F.col(target), F.col(x)).alias("slope"))


def apply_line(rows: DataFrame, lines: DataFrame, x: str | Column = "interval_mm", name: str = "expected") -> DataFrame:
    x = F.col(x) if isinstance(x, str) else x
    joined = rows.join(F.broadcast(lines), "season")         # one row per season of the year
    return joined.withColumn(name, F.col("intercept") + F.col("slope") * x).drop("intercept", "slope")


def residuals(rows: DataFrame, target: str = "delta") -> DataFrame:
    """Observed minus expected; positive means it fell more than the driver explains."""
    return rows.withColumn("residual", F.col(target) - F.col("expected"))


def _merge_rare(rows: DataFrame, column: str, train: Column, fewest: int) -> DataFrame:
    """Training levels with too few rows share one level; unseen ones are left for the indexer to ignore."""
    level = F.coalesce(F.col(column), F.lit("unknown"))
    counts = (rows.where(train).groupBy(level.alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") < fewest).select("_level", F.lit(True).alias("_rare")))
    return (rows.withColumn("_level", level).join(counts, "_level", "left")
            .withColumn(column, F.when(F.col("_rare"), "(rare)").otherwise(F.col("_level"))).drop("_level", "_rare"))


def _indexers(categories: list[str]) -> list:
    """Alphabetical training levels; unseen ones land in a last bucket, which the encoder leaves out."""
    indexed = [f"{c}_code" for c in categories]
    return [StringIndexer(inputCols=categories, outputCols=indexed, stringOrderType="alphabetAsc",
                          handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_hot" for c in categories], dropLast=True)]


def encoded(rows: DataFrame, numeric: list[str], train: Column) -> DataFrame:
    """Scaled rows, for a fit. The rows are written out first: statistics and fits read them many times."""
    rows = staged(rows)
    return encode.encode_numeric(rows, numeric, encode.saved(encode.numeric_stats(rows, numeric, train)))


def fit_ridge(rows: DataFrame, numeric: list[str], categories: list[str], train: Column, alpha: float = 1.0,
              fewest: int = 20, target: str = "delta") -> tuple[PipelineModel, DataFrame]:
    """Ridge on standardised numbers and one-hot categories; returns the model and the encoded rows.

    The penalty is ``alpha`` on unscaled coefficients: Spark divides the loss by the row count and the label by
    its population spread, so the parameter is scaled back.
    """
    table = encoded(rows, numeric, train)
    for c in categories:
        table = _merge_rare(table, c, train, fewest)
    fitted_on = table.where(train)
    size = fitted_on.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("sd")).first()
    stages = [*_indexers(categories),
              VectorAssembler(inputCols=[*numeric, *[f"{c}_hot" for c in categories]], outputCol="features"),
              LinearRegression(featuresCol="features", labelCol=target, predictionCol="expected",
                               elasticNetParam=0.0, standardization=False, solver="normal",
                               regParam=alpha * size["sd"] / size["n"])]
    return Pipeline(stages=stages).fit(fitted_on), table


def fit_boosting(rows: DataFrame, numeric: list[str], categories: list[str], train: Column, valid: Column,
                 rounds: int = 800, depth: int = 6, target: str = "delta") -> tuple[PipelineModel, DataFrame]:
    """Boosted trees that stop early on the validation rows."""
    table = encoded(rows, numeric, train).withColumn("_valid", valid)
    codes = [f"{c}_code" for c in categories]
    stages = [StringIndexer(inputCols=categories, outputCols=codes, stringOrderType="alphabetAsc",
                            handleInvalid="keep"),
              VectorAssembler(inputCols=[*numeric, *codes], outputCol="features"),
              GBTRegressor(featuresCol="features", labelCol=target, predictionCol="expected", maxIter=rounds,
                           maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=40,
                           validationIndicatorCol="_valid", validationTol=0.001, seed=SEED)]
    return Pipeline(stages=stages).fit(table.where(train | valid)), table


def fit_forest(rows: DataFrame, numeric: list[str], train: Column, trees: int = 60, depth: int = 14,
               target: str = "delta") -> PipelineModel:
    stages = [VectorAssembler(inputCols=numeric, outputCol="features"),
              RandomForestRegressor(featuresCol="features", labelCol=target, predictionCol="expected",
                                    numTrees=trees, maxDepth=depth, seed=SEED)]
    return Pipeline(stages=stages).fit(encoded(rows, numeric, train).where(train))


def importances(model: PipelineModel, names: list[str], spark, top: int | None = None) -> DataFrame:
    """Feature importances of a fitted tree model, largest first: one row per feature."""
    weights = model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, importance double")
    ordered = table.orderBy(F.desc("importance"), "feature")
    return ordered if top is None else ordered.limit(top)


def held_out_means(rows: DataFrame, fold: str, target: str = "delta") -> DataFrame:
    """Season means fitted on the other folds: all sums less those of the row's own fold, so no fold is fitted apart."""
    sums = rows.groupBy(fold, "season").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    whole = sums.groupBy("season").agg(F.sum("_s").alias("_all"), F.sum("_n").alias("_rows"))
    means = sums.join(whole, "season").where(F.col("_rows") > F.col("_n")).select(
        fold, "season", ((F.col("_all") - F.col("_s")) / (F.col("_rows") - F.col("_n"))).alias("expected"))
    # one row per fold and season of the year
    return rows.join(F.broadcast(means), [fold, "season"])


def cross_validate(rows: DataFrame, fold: str, folds: int, fit_predict) -> DataFrame:
    """Hold out each fold in turn; ``fit_predict(train rows, held-out rows)`` adds ``expected`` to the latter."""
    from functools import reduce
    parts = [fit_predict(rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)
