"""Positions, seeded orders, batches and permutations without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import pinned

# Rows a partition may hold under monotonically_increasing_id.
_PARTITION_SPAN = 1 << 33
# Leading hex digits of an md5 that name its bucket: 65,536 buckets.
_BUCKET_DIGITS = 4


def with_row_index(df: DataFrame, order_by: list[Column | str], name: str = "row_index") -> DataFrame:
    """Add the 1-based position of each row under `order_by` (which must end in a unique key).

    The rows are range-partitioned, sorted inside their partitions and pinned,
    because range bounds are sampled and may differ when a lost partition is
    computed again. A row's position is then its place in the partition plus the
    sizes of the partitions before it: one number per partition, so that table is
    safe to broadcast.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    fixed = pinned(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = fixed.withColumn("_part", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id() % _PARTITION_SPAN
    )
    sizes = placed.groupBy("_part").count().orderBy("_part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["_part"], total))
        total += row["count"]
    table = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return (
        placed.join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_start") + F.col("_place") + 1)
        .drop("_part", "_place", "_start")
    )


def seeded_digest(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def with_seeded_position(
    df: DataFrame, key: str, seed: int | str, name: str = "position", within: list[str] | None = None
) -> DataFrame:
    """Add the 1-based position of each row in a random order fixed by `seed`.

    The order is that of md5(key|seed). Digests spread evenly whatever the keys
    are, so their first digits cut the order into buckets of known bounds: each
    bucket is ranked on its own and shifted by the sizes of the buckets before it.
    With `within`, positions count from 1 inside each group; a group that holds
    most rows still spreads over all buckets. Keys must be unique.
    """
    groups = list(within or [])
    bucketed = df.withColumn("_digest", seeded_digest(F.col(key), seed)).withColumn(
        "_bucket", F.substring("_digest", 1, _BUCKET_DIGITS)
    )
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy(*groups, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    if not groups:
        starts = F.broadcast(starts)  # at most one row per bucket
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_digest", key)
    starts = starts.withColumnsRenamed({c: f"_of_{c}" for c in (*groups, "_bucket")})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in groups]  # NULL is a group of its own
    return (
        bucketed.join(starts, [F.col("_bucket") == F.col("_of__bucket"), *same])
        .withColumn(name, F.col("_start") + F.row_number().over(inside))
        .select(*df.columns, name)
    )


def with_batch(df: DataFrame, position: str, size: int = 100, name: str = "batch_id") -> DataFrame:
    """Number the slices of `size` rows along a position column, from 0."""
    return df.withColumn(name, F.floor((F.col(position) - 1) / size).cast("bigint"))


def permuted_column(df: DataFrame, key: str, column: str, seed: int | str, name: str) -> DataFrame:
    """Give each row another row's value of `column`; together they keep its multiset.

    Receivers stand in one seeded order, values in a second; equal positions meet.
    """
    receivers = with_seeded_position(df, key, f"{seed}", "_position")
    donors = with_seeded_position(df.select(key, column), key, f"{seed}|{column}", "_position")
    donors = donors.select("_position", F.col(column).alias(name))
    return receivers.join(donors, "_position").drop("_position")


def split_by_order(df: DataFrame, order_by: list[str], head_share: float = 0.8) -> DataFrame:
    """Mark the first `floor(head_share * n)` rows 'head' and the others 'tail'.

    Only the order columns are sorted, to find the last key of the head; the rows
    themselves are compared with it where they are.
    """
    indexed = with_row_index(df.select(*order_by), order_by, "_row")
    rows = indexed.agg(F.count(F.lit(1)).alias("n"))
    cutoff = rows.select(F.floor(F.col("n") * F.lit(head_share))).scalar()
    last = indexed.where(F.col("_row") == cutoff).select(F.struct(*order_by)).scalar()
    return df.withColumn("split", F.when(F.struct(*order_by) <= last, "head").otherwise("tail"))
