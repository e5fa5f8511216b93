"""Folds that keep groups whole, training masks and leak checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.operators.joins import attach_by_group
from foldwright.operators.rowindex import with_row_index


def _spread(loads: list[int], size: int, count: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """Give `count` groups of `size` rows, one by one, to the fold with the least rows.

    Fold f takes a group whenever its load, one of loads[f] + t * size, is the
    least of all (ties to the first fold). So the folds take turns: while the
    least load lies between two starting loads, the folds that started below take
    turns in a fixed cycle, and one more fold joins at every starting load. That
    gives at most one segment (first rank, cycle) per fold, however many groups.
    """
    order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    segments: list[tuple[int, list[int]]] = []
    taken = [0] * len(loads)
    used = 0
    for joined, newest in enumerate(order, start=1):
        if used == count:
            break
        level = loads[newest]
        turn = {f: loads[f] + -((loads[f] - level) // size) * size for f in order[:joined]}
        cycle = sorted(turn, key=lambda f: (turn[f], f))
        room = count - used
        if joined < len(order):
            ceiling = loads[order[joined]]
            room = min(room, sum(max(0, -((turn[f] - ceiling) // size)) for f in cycle))
        if room == 0:
            continue
        segments.append((used, cycle))
        for place, f in enumerate(cycle):
            taken[f] += room // joined + (place < room % joined)
        used += room
    return segments, [load + n * size for load, n in zip(loads, taken)]


def _dealt(ranked: DataFrame, group: str, folds: int, place: Column) -> DataFrame:
    """Add the fold to (group, n, _row, _first): groups of one size take turns in the order of `place`, from 0."""
    classes = ranked.groupBy("n").agg(F.count(F.lit(1)).alias("groups"), F.min("_first").alias("first"))
    loads, table = [0] * folds, []
    for row in classes.orderBy(F.desc("n")).collect():
        segments, loads = _spread(loads, row["n"], row["groups"])
        table.append((row["n"], [s for s, _ in segments], [c for _, c in segments]))
    schema = "_size bigint, _starts array<bigint>, _cycles array<array<int>>"
    # Always small: N rows have at most sqrt(2 N) group sizes, and the loop above has held them all.
    turns = F.broadcast(ranked.sparkSession.createDataFrame(table, schema))
    segment = F.size(F.filter("_starts", lambda start: start <= F.col("_place")))
    cycle = F.element_at("_cycles", segment)
    turn = (F.col("_place") - F.element_at("_starts", segment)) % F.size(cycle)
    placed = ranked.withColumn("_place", place).join(turns, F.col("n") == F.col("_size"))
    return placed.withColumn("fold", F.get(cycle, turn.cast("int"))).drop("_place", "_size", "_starts", "_cycles")


def _with_class_start(ranked: DataFrame) -> DataFrame:
    """Add `_first`, the row number at which the groups of a size begin."""
    first = F.broadcast(ranked.groupBy(F.col("n").alias("_size")).agg(F.min("_row").alias("_first")))  # one row per size
    return ranked.join(first, F.col("n") == F.col("_size")).drop("_size")


def balanced_group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold): groups by size, largest first, each to the fold with the least rows.

    Equal sizes go by key. The rule is sequential, but groups of one size take
    turns over the folds in a way that can be written down (see `_spread`), so
    only the distinct sizes are walked through on the driver: at most sqrt(2 N) of
    them for N rows, one small row each. Each group then finds its fold from its size and its
    rank among the groups of that size. No fold splits a group, and every group count
    gives the result of the plain rule.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = _with_class_start(with_row_index(sizes, [F.desc("n"), F.asc(group)], "_row"))
    return _dealt(ranked, group, folds, F.col("_row") - F.col("_first")).select(group, "n", "fold")


def target_balanced_folds(df: DataFrame, group: str, target: str, folds: int) -> DataFrame:
    """(group, n, total, fold): folds balanced by size and, within each group size, by `target`.

    Groups of one size stand in the order of their totals (which is that of their means), then of
    their keys. They are cut into runs of `folds`, every second run is turned round, and in that order
    each goes to the fold with the least rows. So the folds get as many rows as in
    `balanced_group_folds`, and of each size high and low totals alike. A group finds its fold from its size and rank, as there;
    no task walks over the groups. NULL targets count 0.
    """
    items = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(target), F.lit(0)).alias("total"))
    ranked = _with_class_start(with_row_index(items, [F.desc("n"), F.asc("total"), F.asc(group)], "_row"))
    sizes = ranked.groupBy(F.col("n").alias("_size")).agg(F.count(F.lit(1)).alias("_groups"))
    ranked = ranked.join(F.broadcast(sizes), F.col("n") == F.col("_size")).drop("_size")  # one row per size
    rank = F.col("_row") - F.col("_first")
    run = F.floor(rank / folds)
    length = F.least(F.lit(folds), F.col("_groups") - run * folds)
    place = F.when(run % 2 == 0, rank).otherwise(run * folds + (length - 1 - rank % folds)).cast("bigint")
    return _dealt(ranked, group, folds, place).select(group, "n", "total", "fold")


def attach_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Rows with the fold of their group."""
    return attach_by_group(df, folds.select(group, "n", "fold"), [group], "n")


def fold_summary(df: DataFrame, fold: str, columns: list[str]) -> DataFrame:
    """(fold, size, mean of each column) in one pass."""
    means = [F.avg(c).alias(f"mean_{c}") for c in columns]
    return df.groupBy(fold).agg(F.count(F.lit(1)).alias("size"), *means)


def leaking_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """(group, n_folds, folds) for groups found in more than one fold; any pair of folds counts."""
    seen = df.select(group, fold).distinct()
    found = seen.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_folds"), F.array_sort(F.collect_list(fold)).alias("folds")
    )
    return found.where("n_folds > 1").withColumn("folds", F.concat_ws(",", F.col("folds").cast("array<string>")))


def training_rows(df: DataFrame, fold: int, fold_column: str = "fold", holdout: str = "holdout") -> DataFrame:
    """Rows a model for `fold` may learn from."""
    return df.where((F.col(fold_column) != fold) & ~F.col(holdout))


def validation_rows(df: DataFrame, fold: int, fold_column: str = "fold", holdout: str = "holdout") -> DataFrame:
    return df.where((F.col(fold_column) == fold) & ~F.col(holdout))
