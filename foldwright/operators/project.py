"""Choosing and deriving columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Names that match a regular expression from the start."""
    return [c for c in df.columns if re.match(pattern, c)]


def of_type(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    """Names of the columns of the given types, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return of_type(df, T.LongType, T.IntegerType, T.DoubleType, T.FloatType)


def excluding(df: DataFrame, *lists: list[str]) -> list[str]:
    """Names on none of the lists, in table order; lists may repeat names."""
    avoid = {name for names in lists for name in names}
    return [c for c in df.columns if c not in avoid]


def select_names(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])
