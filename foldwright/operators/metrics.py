"""Scores, importance roll-ups and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.functions.numeric import rmse
from foldwright.operators.joins import attach_by_group
from foldwright.session import stored


def rmse_by(df: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """(by, rmse); without `by` one row. Partial sums are taken before the shuffle."""
    return df.groupBy(*by).agg(rmse(F.col(actual), F.col(predicted)).alias("rmse"))


def score_summary(scores: DataFrame, score: str = "rmse") -> DataFrame:
    """(mean_rmse, std_rmse) over folds; std divides by n."""
    return scores.agg(F.avg(score).alias("mean_rmse"), F.stddev_pop(score).alias("std_rmse"))


def out_of_fold_means(df: DataFrame, fold: str, category: str, target: str) -> DataFrame:
    """Predict each row by its category's mean over the other folds (their overall mean for unseen levels).

    One aggregation by (fold, category) serves all folds: a fold's training sums
    are the totals less its own.
    """
    own = stored(
        df.groupBy(fold, category).agg(
            F.sum(target).alias("_sum"), F.count(target).alias("_n"), F.count(F.lit(1)).alias("_rows")
        )
    )
    per_level = own.groupBy(category).agg(F.sum("_sum").alias("_level_sum"), F.sum("_n").alias("_level_n"))
    per_fold = own.groupBy(fold).agg(F.sum("_sum").alias("_fold_sum"), F.sum("_n").alias("_fold_n"))
    whole = own.agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    whole_sum, whole_n = whole.select("_sum").scalar(), whole.select("_n").scalar()

    level = per_level.withColumnRenamed(category, "_level")
    per_fold = per_fold.withColumnRenamed(fold, "_of_fold")
    seen = own.join(level, F.col(category).eqNullSafe(F.col("_level")))
    seen = seen.join(per_fold, F.col(fold).eqNullSafe(F.col("_of_fold")))  # rows without a fold are one
    n = F.col("_level_n") - F.col("_n")
    learned = F.when(n > 0, (F.col("_level_sum") - F.col("_sum")) / n)
    overall = F.try_divide(whole_sum - F.col("_fold_sum"), whole_n - F.col("_fold_n"))
    table = seen.select(fold, category, "_rows", F.coalesce(learned, overall).alias("prediction"))
    return attach_by_group(df, table, [fold, category], "_rows")


def mean_of_fold_models(train: DataFrame, rows: DataFrame, fold: str, category: str, target: str) -> DataFrame:
    """`rows` with the average, over the folds of `train`, of the category mean learned outside each fold.

    Every fold's model predicts every row, as for a holdout; one aggregation of `train` by (fold, category) serves
    all of them. Levels that a model has not seen get its overall mean, NULL is a level of its own.
    """
    own = stored(train.groupBy(fold, category).agg(F.sum(target).alias("_sum"), F.count(target).alias("_n")))
    folds = own.groupBy(fold).agg(F.sum("_sum").alias("_fold_sum"), F.sum("_n").alias("_fold_n"))
    totals = own.agg(F.sum("_sum"), F.sum("_n")).first()
    # One row per fold: what its model answers for levels it has not seen.
    overall = folds.select(
        F.col(fold).alias("_fold"), F.try_divide(F.lit(totals[0]) - F.col("_fold_sum"), F.lit(totals[1]) - F.col("_fold_n")).alias("_overall")
    )
    levels = own.groupBy(category).agg(F.sum("_sum").alias("_level_sum"), F.sum("_n").alias("_level_n"))
    listed = overall.agg(F.collect_list(F.struct("_fold", "_overall"))).scalar()
    every = levels.withColumn("_f", F.explode(listed)).select(category, "_level_sum", "_level_n", "_f._fold", "_f._overall")
    held = own.withColumnsRenamed({fold: "_own_fold", category: "_own_level"})
    same = F.col("_fold").eqNullSafe(F.col("_own_fold")) & F.col(category).eqNullSafe(F.col("_own_level"))
    met = every.join(held, same, "left")
    n = F.col("_level_n") - F.coalesce("_n", F.lit(0))
    learned = F.when(n > 0, (F.col("_level_sum") - F.coalesce("_sum", F.lit(0.0))) / n)
    table = met.groupBy(category).agg(F.avg(F.coalesce(learned, F.col("_overall"))).alias("prediction"))
    unseen = overall.agg(F.avg("_overall")).first()[0]
    table = table.withColumnRenamed(category, "_level")
    found = rows.join(table, F.col(category).eqNullSafe(F.col("_level")), "left").drop("_level")
    return found.withColumn("prediction", F.coalesce("prediction", F.lit(unseen)))


def importance_rollup(importances: DataFrame) -> DataFrame:
    """Per feature over folds: sum of positive importances, non-positive folds, mean, std (over n)."""
    value = F.col("importance")
    return importances.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(value > 0, value)), F.lit(0.0)).alias("total_importance"),
        F.count_if(value <= 0).alias("non_positive_folds"),
        F.avg(value).alias("mean_importance"),
        F.stddev_pop(value).alias("std_importance"),
    )


def useless_features(rollup: DataFrame, folds: int) -> DataFrame:
    """Features without positive importance in at least `folds` folds."""
    return rollup.where(F.col("non_positive_folds") >= folds)


def ranked(df: DataFrame, value: str, key: str, descending: bool = True) -> DataFrame:
    """Sorted by value, ties by key."""
    return df.orderBy(F.desc(value) if descending else F.asc(value), F.asc(key))


def best_by(trials: DataFrame, score: str, *columns: str) -> DataFrame:
    """The columns of the row with the lowest score; a NaN score never wins, ties go to the first columns."""
    valid = trials.where(~F.isnan(score) & F.col(score).isNotNull())
    picked = F.struct(*columns)
    best = valid.agg(F.min_by(picked, F.struct(F.col(score), picked)).alias("_best"))
    return best.select("_best.*")
