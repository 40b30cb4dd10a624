"""Expressions on fixed-step arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def chunk_sums(values: Column, width: int, chunks: int) -> Column:
    """Sums of ``chunks`` runs of ``width`` values: 728 days become 104 weeks with ``(7, 104)``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(chunks - 1)),
        lambda i: F.aggregate(F.slice(values, i * width + 1, F.lit(width)), F.lit(0.0), lambda a, v: a + v))


def differences(prefix: Column, start: Column, width: int, chunks: int) -> Column:
    """``prefix[start + width*(i+1)] - prefix[start + width*i]`` for every chunk ``i``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(chunks - 1)),
        lambda i: F.get(prefix, start + (i + 1) * width) - F.get(prefix, start + i * width))


def keep_last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - n + 1), F.lit(n))


def patches(values: Column, width: int, count: int) -> Column:
    """``count`` sub-arrays of ``width`` values each, oldest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)),
                       lambda i: F.slice(values, i * width + 1, F.lit(width)))


def pick_channels(weeks: Column, names: list[str]) -> Column:
    """Keep only the named fields of an array of structs."""
    return F.transform(weeks, lambda w: F.struct(*[w[n].alias(n) for n in names]))


def mean_known(*values: Column) -> Column:
    """Mean of the values that are not null, across columns of one row."""
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return total / F.nullif(F.size(known), F.lit(0))
