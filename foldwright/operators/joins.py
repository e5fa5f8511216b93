"""Joins on ids, lookups with defaults and checks of returned ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.session import stored

# A group counts as hot when it holds at least one row in this many.
HOT_SHARE = 1000
_SALTS = 1000
# Lookups of up to this many groups are broadcast whole.
BROADCAST_GROUPS = 100_000


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_anti")


def attach_by_group(
    rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, how: str = "inner"
) -> DataFrame:
    """Give each row its group's lookup values, without moving the rows of hot groups.

    `lookup` has one row per group of `rows`, with the group's row count in
    `weight`. It is stored and counted first. Up to BROADCAST_GROUPS groups are
    broadcast whole. Beyond, only groups with at least one row in HOT_SHARE are: there
    can be no more than HOT_SHARE of them. Rows of the other groups are shuffled on
    their key. NULL keys form a group of their own. With `how="left"` rows of groups
    the lookup lacks stay, with NULLs.
    """
    values = [c for c in lookup.columns if c not in (*keys, weight)]
    kept = stored(lookup.select(*[F.col(k).alias(f"_{k}") for k in keys], *values, weight))
    groups, total = kept.agg(F.count(F.lit(1)), F.sum(weight)).first()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]

    def joined(part: DataFrame, side: DataFrame, kind: str) -> DataFrame:
        return part.join(side, same, kind).drop(*[f"_{k}" for k in keys])

    if groups <= BROADCAST_GROUPS:
        return joined(rows, F.broadcast(kept.drop(weight)), how)
    # The rows are read once: those of hot groups find their values in the first join and go through
    # the second under random salts, where nothing meets them.
    hot = kept.where(F.col(weight) * HOT_SHARE >= total).select(*[f"_{k}" for k in keys], F.struct(*values, F.lit(1).alias("_in")).alias("_hot"))
    cold = kept.where(F.col(weight) * HOT_SHARE < total).select(
        *[F.col(f"_{k}") for k in keys], F.lit(0).alias("_none"), F.struct(*values, F.lit(1).alias("_in")).alias("_cold")
    )
    marked = joined(rows, F.broadcast(hot), "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)) + 1).otherwise(0)
    met = marked.withColumn("_salt", salt.cast("int")).join(cold, [*same, F.col("_salt") == F.col("_none")], "left")
    found = F.coalesce("_hot", "_cold")
    if how == "inner":
        met = met.where(found.isNotNull())
    return met.select(*rows.columns, *[found[v].alias(v) for v in values])


def lookup_or(df: DataFrame, table: DataFrame, on: Column, value: str, default: Column) -> DataFrame:
    """Left lookup of `value`; rows without a match, or with a NULL there, get `default`."""
    found = df.join(table, on, "left")
    return found.withColumn(value, F.coalesce(F.col(value), default))


def attach_by_key(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Add the columns of `other` by key; order never matters."""
    return df.join(other, key)


def reconcile(expected: DataFrame, predicted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, issue) for every id that was not predicted exactly once with a value.

    Both sides shrink to one row per id before they meet, so an id returned very
    often costs no more than the others. Clean input gives no rows.
    """
    wanted = expected.groupBy(key).agg(F.count(F.lit(1)).alias("_wanted"))
    given = predicted.groupBy(key).agg(
        F.count(F.lit(1)).alias("_given"), F.count_if(F.col(value).isNull()).alias("_nulls")
    )
    g = given.withColumnRenamed(key, "_key")
    both = wanted.join(g, F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    issue = (
        F.when(F.col("_given").isNull(), "missing")
        .when(F.col("_wanted").isNull(), "extra")
        .when(F.col("_given") > F.col("_wanted"), "duplicate")
        .when(F.col("_given") < F.col("_wanted"), "missing")
        .when(F.col("_nulls") > 0, "null_prediction")
    )
    known = F.when(F.col("_wanted").isNull(), F.col("_key")).otherwise(F.col(key))
    return both.select(known.alias(key), issue.alias("issue")).where("issue is not null")
