"""Folds, random splits by entity, and checks that they do not leak."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.constants import DISTRICT_FOLDS, SEED
from .ranking import hashed_order


def fold_of(df: DataFrame, key: str, folds: int = DISTRICT_FOLDS, seed: int = SEED) -> DataFrame:
    """One row per distinct key with its fold; sizes differ by at most one."""
    keyed = df.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(key))
    return hashed_order(keyed, key, seed).select(key, (F.col("place") % folds).cast("int").alias("fold"))


def entity_split(df: DataFrame, entity: str, seed: int = SEED, valid: float = 0.15, test: float = 0.15) -> DataFrame:
    """One row per entity with ``test``, ``valid`` or ``train``, shares counted in entities."""
    place, n = F.col("place"), F.col("entities")
    n_test, n_valid = F.bround(n * test, 0), F.bround(n * valid, 0)
    return hashed_order(df, entity, seed).select(entity, F.when(place < n_test, "test").when(
        place < n_test + n_valid, "valid").otherwise("train").alias("split"))


def crossing_entities(df: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """How many entities have rows in more than one split; must be 0."""
    per = df.groupBy(entity).agg(F.countDistinct(split).alias("_n"))
    return per.agg(F.count_if(F.col("_n") > 1).alias("crossing"), F.count(F.lit(1)).alias("entities"))


def split_balance(df: DataFrame, entity: str, target: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(entity).alias("entities"),
                                 F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))
