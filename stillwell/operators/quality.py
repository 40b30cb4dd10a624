"""Reports and assertions about a table, each from one pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def count_report(df: DataFrame, cases: dict[str, Column]) -> DataFrame:
    """Rows ``(case, count)``: how often each condition holds, all in one aggregate."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in cases.items()])
    return counts.unpivot([], list(cases), "case", "count")


def quality_checks(df: DataFrame, unique: str, not_null: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """Rows ``(check, failures)`` for a unique key, known values and closed value sets."""
    parts = [(F.count(F.lit(1)) - F.countDistinct(unique)).alias(f"{unique}_unique")]
    parts += [F.count_if(F.col(c).isNull()).alias(f"{c}_known") for c in not_null]
    parts += [F.count_if(~F.col(c).isin(v)).alias(f"{c}_allowed") for c, v in allowed.items()]
    checks = df.agg(*parts)
    return checks.unpivot([], checks.columns, "check", "failures")


def outside(df: DataFrame, keys: list[str], reference: DataFrame) -> DataFrame:
    """Distinct keys that the reference does not have."""
    return df.select(*keys).distinct().join(reference, keys, "left_anti")


def require(checks: DataFrame) -> None:
    """Raise if any check of :func:`quality_checks` failed."""
    failed = [f"{r['check']}: {r['failures']}" for r in checks.where("failures > 0").take(50)]
    if failed:
        raise ValueError("; ".join(failed))


def build_report(rows: DataFrame, entity: str, target: str) -> DataFrame:
    """Rows, entities and target statistics by split and overall."""
    return rows.rollup("split").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(entity).alias("entities"), F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std")).withColumn("split", F.coalesce("split", F.lit("all")))


def channel_summary(week_rows: DataFrame, channels: list[str]) -> DataFrame:
    """Mean, spread and range of every channel."""
    long = week_rows.select(*channels).unpivot([], channels, "channel", "v")
    return long.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                                       F.min("v").alias("min"), F.max("v").alias("max"))
