"""Name -> Spark query and, where SQL can say it, name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return register


# Results are rounded on both sides. The small shift moves exact halves off the rounding boundary, where the two
# engines may differ, and adding zero removes the sign of a zero.
def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-9), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column."""
    return df.select(*[r(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(expression: str, digits: int = 6) -> str:
    return f"(round(({expression})::DOUBLE + 1e-9, {digits}) + 0::DOUBLE)"
