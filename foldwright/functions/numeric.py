"""Arithmetic expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_safe_sum(columns: list[Column]) -> Column:
    """Row-wise sum in which NULL counts as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0)) for c in columns))


def rounded_even(value: Column, digits: int = 3) -> Column:
    """Round with ties to the even digit."""
    return F.bround(value, digits)


def z_score(value: Column, mean: Column, std: Column, eps: float = 1e-4) -> Column:
    """Standard score; `eps` keeps a zero deviation from dividing by zero."""
    return (value - mean) / (std + F.lit(eps))


def hash32(*parts: Column) -> Column:
    """First 32 bits of the md5 of the parts joined by '|'.

    Unlike `rand(seed)` this depends on the values alone, so it stays the same
    under any partitioning.
    """
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_fold(key: Column, folds: int, seed: int) -> Column:
    """Fold number from the key alone."""
    return (hash32(key, F.lit(seed)) % folds).cast("int")


def squared_error(actual: Column, predicted: Column) -> Column:
    return (actual - predicted) * (actual - predicted)


def rmse(actual: Column, predicted: Column) -> Column:
    """Aggregate: root of the mean squared error."""
    return F.sqrt(F.avg(squared_error(actual, predicted)))
