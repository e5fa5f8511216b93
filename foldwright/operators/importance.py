"""Permutation importance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.numeric import hash32, squared_error
from foldwright.operators.rowindex import with_seeded_position
from foldwright.session import stored

Scorer = Callable[[DataFrame], DataFrame]


def shift(rows, seed: int, repeat):
    """How far the donors of a repeat stand from the receivers: 1 .. rows - 1."""
    return F.when(rows > 1, hash32(F.lit(seed), repeat) % (rows - 1) + 1).otherwise(0)


def placed_rows(
    df: DataFrame, key: str, features: list[str], target: str, seed: int, within: list[str] | None = None
) -> DataFrame:
    """(within, _place, _target, features): rows in a seeded random order per group, stored.

    The order and the features are read by several branches of the scoring plan.
    """
    groups = list(within or [])
    base = df.select(
        *groups,
        key,
        F.col(target).cast("double").alias("_target"),
        F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("features"),
    )
    return stored(with_seeded_position(stored(base), key, seed, "_place", groups).drop(key))


def _same(columns: list[str]):
    """Join condition of equal columns, NULL being a group of its own."""
    return [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns]


def met_donors(placed: DataFrame, repeats: int, seed: int, groups: list[str]) -> DataFrame:
    """(groups, _target, _own, _donor, repeat): every row with its donor's features, once a repeat.

    In repeat r the donor stands `shift` places further on in the row's group, which is a
    permutation of the rows. Other columns of `placed` than its features and place stay.
    """
    sizes = placed.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
    receivers = placed.withColumnRenamed("features", "_own")
    if groups:
        sizes = sizes.withColumnsRenamed({g: f"_of_{g}" for g in groups})
        receivers = receivers.join(sizes, _same(groups)).drop(*[f"_of_{g}" for g in groups])
    else:
        receivers = receivers.withColumn("_rows", sizes.scalar())
    receivers = receivers.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    receivers = receivers.withColumn(
        "_from", (F.col("_place") - 1 + shift(F.col("_rows"), seed, F.col("repeat"))) % F.col("_rows") + 1
    ).drop("_place", "_rows")
    donors = placed.select(*groups, F.col("_place").alias("_from"), F.col("features").alias("_donor"))
    donors = donors.withColumnsRenamed({g: f"_of_{g}" for g in (*groups, "_from")})
    return receivers.join(donors, _same([*groups, "_from"])).drop("_from", *[f"_of_{g}" for g in (*groups, "_from")])


def importance_of(
    placed: DataFrame, features: list[str], score: Scorer, repeats: int, seed: int, within: list[str] | None = None
) -> DataFrame:
    """(within, feature, repeat, importance): rise of the RMSE when a feature's values are permuted.

    `score` adds `prediction` to a frame with a `features` array. One join brings the donor's
    features for all of them, see `met_donors`; putting in one feature at a time, scoring and
    summing errors then stay inside the task, so no frame of rows x features x repeats is
    shuffled. Permuted and plain errors are summed over the same rows in the same order, so
    an unused feature scores exactly 0.
    """
    groups = list(within or [])
    plain = score(placed).withColumn("_plain", squared_error(F.col("_target"), F.col("prediction"))).drop("prediction")
    met = met_donors(plain, repeats, seed, groups)
    varied = met.withColumn("_feature", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    swapped = F.transform(
        "_own", lambda own, i: F.when(i == F.col("_feature"), F.get("_donor", i)).otherwise(own)
    )
    scored = score(varied.withColumn("features", swapped).drop("_own", "_donor"))
    names = F.array(*[F.lit(c) for c in features])
    by = [*groups, "feature", "repeat"]
    return (
        scored.withColumn("feature", F.get(names, F.col("_feature")))
        .groupBy(*by)
        .agg(
            F.sqrt(F.avg(squared_error(F.col("_target"), F.col("prediction")))).alias("_permuted"),
            F.sqrt(F.avg("_plain")).alias("_baseline"),
        )
        .select(*by, (F.col("_permuted") - F.col("_baseline")).alias("importance"))
    )


def permutation_importance(
    df: DataFrame,
    key: str,
    features: list[str],
    target: str,
    score: Scorer,
    repeats: int,
    seed: int,
    within: list[str] | None = None,
) -> DataFrame:
    """(within, feature, repeat, importance) of one scorer over all rows, see `importance_of`."""
    placed = placed_rows(df, key, features, target, seed, within)
    return importance_of(placed, features, score, repeats, seed, within)


def mean_importance(importances: DataFrame, *by: str) -> DataFrame:
    """(by, feature, importance, std) over the repeats; std divides by their number."""
    return importances.groupBy(*by, "feature").agg(
        F.avg("importance").alias("importance"), F.stddev_pop("importance").alias("std")
    )


def linear_scorer(weights: list[float], intercept: float = 0.0) -> Scorer:
    """Fixed linear prediction from the `features` array, added in array order."""

    def score(df: DataFrame) -> DataFrame:
        total = F.lit(float(intercept))
        for i, weight in enumerate(weights):
            total = total + F.lit(float(weight)) * F.get("features", F.lit(i))
        return df.withColumn("prediction", total)

    return score


def model_scorer(model) -> Scorer:
    """Prediction of a fitted MLlib regression model over the `features` array."""
    from pyspark.ml.functions import array_to_vector

    def score(df: DataFrame) -> DataFrame:
        vectors = df.withColumn("_vector", array_to_vector("features"))
        scorer = model.copy().setFeaturesCol("_vector").setPredictionCol("prediction")
        return scorer.transform(vectors).drop("_vector")

    return score
