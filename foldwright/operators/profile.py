"""Column profiles of wide tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Aggregates per job: wide tables are profiled in slices of this many columns,
# so that generated code stays small.
_SLICE = 100
# Longer texts travel as digests, which are longer than this: no short text equals one.
_LONG = 100
# A screen by approximate counts must miss by this factor to go wrong; the
# estimate's relative error is 5 %.
_SCREEN = 2


def _slices(columns: list[str]) -> list[list[str]]:
    return [columns[i : i + _SLICE] for i in range(0, len(columns), _SLICE)]


def _per_column(df: DataFrame, columns: list[str], stats: dict) -> DataFrame:
    """One row (column, *stats) per column; `stats` maps a name to column -> aggregate."""

    def one_slice(names: list[str]) -> DataFrame:
        aggregates = [
            F.struct(F.lit(c).alias("column"), *[make(F.col(f"`{c}`")).alias(s) for s, make in stats.items()]).alias(
                f"s{i}"
            )
            for i, c in enumerate(names)
        ]
        return df.agg(*aggregates).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))

    return reduce(DataFrame.unionByName, [one_slice(names) for names in _slices(columns)])


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, value as text). A value's text tells it apart from every other value."""
    nested = (T.ArrayType, T.StructType, T.MapType)

    def text(name: str) -> Column:
        column = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, nested):
            return F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            column = column + F.lit(0.0)  # -0.0 is 0.0
        if isinstance(df.schema[name].dataType, T.TimestampType):
            column = F.unix_micros(column)  # the text of an instant may repeat when clocks change
        return column.cast("string")

    def short(value: Column) -> Column:
        return F.when(F.length(value) > _LONG, F.sha2(value, 512)).otherwise(value)

    pairs = [F.struct(F.lit(c).alias("column"), short(text(c)).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def n_unique(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_unique), NULL counting as a value.

    Values are grouped before they are counted, so a frequent value travels once
    per task and not once per row.
    """
    names = columns or df.columns
    return (
        _long(df, names)
        .groupBy("column", "value")
        .agg(F.lit(1).alias("seen"))
        .groupBy("column")
        .agg(F.count("seen").alias("n_unique"))
    )


def constant_flags(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, is_constant): one value throughout, or NULL throughout. No distinct, no value shuffle."""

    def constant(c: Column) -> Column:
        complete = (F.count(c) == 0) | (F.count(c) == F.count(F.lit(1)))
        return F.min(c).eqNullSafe(F.max(c)) & complete

    return _per_column(df, columns or df.columns, {"is_constant": constant})


def constant_columns(df: DataFrame) -> list[str]:
    """Names of constant columns, in table order."""
    flagged = {r["column"] for r in constant_flags(df).where("is_constant").collect()}
    return [c for c in df.columns if c in flagged]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def _screened(df: DataFrame, condition: Column) -> list[str]:
    """Columns whose approximate statistics meet `condition` over (approx, nulls, rows)."""
    stats = {
        "approx": lambda c: F.approx_count_distinct(c),
        "nulls": lambda c: F.count_if(c.isNull()),
        "rows": lambda c: F.count(F.lit(1)),
    }
    return [r["column"] for r in _per_column(df, df.columns, stats).where(condition).select("column").collect()]


def id_like_columns(df: DataFrame) -> DataFrame:
    """(column) whose values are all different.

    More than one NULL, or far fewer distinct values than rows, rules a column out
    before the exact count shuffles its values.
    """
    candidates = _screened(df, (F.col("nulls") <= 1) & (F.col("approx") * _SCREEN >= F.col("rows")))
    if not candidates:
        return df.sparkSession.createDataFrame([], "column string")
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return n_unique(df, candidates).where(F.col("n_unique") == rows.scalar()).select("column")


def low_cardinality_columns(df: DataFrame, limit: int = 200) -> DataFrame:
    """(column, n_unique) for columns with fewer than `limit` values.

    The screen leaves columns with few values only, so their sets of values fit in an
    aggregate and are counted exactly without a shuffle of values. A column is only lost if its
    approximate count is twice the true one, twenty times the usual error. All NaN are one value.
    """
    candidates = _screened(df, F.col("approx") <= _SCREEN * limit)
    if not candidates:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint")

    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def exact(c: Column, name: str) -> Column:
        nulls = F.max(c.isNull().cast("int"))
        if name not in fractional:
            return (F.size(F.collect_set(c)) + nulls).cast("bigint")
        odd = F.coalesce(F.max((c.isNotNull() & F.isnan(c)).cast("int")), F.lit(0))
        plain = F.when(~F.isnan(c), c + F.lit(0.0))  # -0.0 is 0.0
        return (F.size(F.collect_set(plain)) + nulls + odd).cast("bigint")

    kinds = [[c for c in candidates if c in fractional], [c for c in candidates if c not in fractional]]
    counted = [
        _per_column(df, names, {"n_unique": lambda c, own=names[0]: exact(c, own)}) for names in kinds if names
    ]
    return reduce(DataFrame.unionByName, counted).where(F.col("n_unique") < limit)


def binary_column_count(df: DataFrame) -> DataFrame:
    """(binary_columns): how many columns hold exactly two values."""
    return low_cardinality_columns(df, 3).agg(F.count_if(F.col("n_unique") == 2).alias("binary_columns"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column."""
    return _per_column(df, df.columns, {"nulls": lambda c: F.count_if(c.isNull())})


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicates): rows minus distinct rows, in one pass."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, count), most frequent first, ties by value."""
    return df.groupBy(column).count().orderBy(F.desc("count"), F.asc(column))


def row_sum_histogram(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """How often each row sum over the matching columns occurs."""
    from foldwright.functions.numeric import null_safe_sum
    from foldwright.operators.project import matching

    total = null_safe_sum([F.col(f"`{c}`") for c in matching(df, pattern)])
    return df.groupBy(total.alias(name)).count().orderBy(name)


def summary(df: DataFrame, column: str) -> DataFrame:
    """(mean, std, min, max) of a column; std divides by n - 1."""
    c = F.col(column)
    return df.agg(
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
    )


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std) per column."""
    stats = {"mean": F.avg, "std": F.stddev_samp}
    return _per_column(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]), columns, stats)


def within_group_max_std(df: DataFrame, group: str, columns: list[str] | None = None) -> DataFrame:
    """(feature, max_std): the largest standard deviation inside any group, ascending."""
    from foldwright.operators.project import numeric_columns

    names = columns or [c for c in numeric_columns(df) if c != group]

    def one_slice(part: list[str]) -> DataFrame:
        inside = df.groupBy(group).agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(c) for c in part])
        return _per_column(inside, part, {"max_std": F.max})

    merged = reduce(DataFrame.unionByName, [one_slice(part) for part in _slices(names)])
    return merged.withColumnRenamed("column", "feature").orderBy("max_std", "feature")


def distinct_count(df: DataFrame, column: str, name: str = "n_distinct") -> DataFrame:
    """Number of different values, NULL counting as one."""
    return df.select(column).distinct().agg(F.count(F.lit(1)).alias(name))
