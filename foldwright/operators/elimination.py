"""Feature elimination by permutation importance over folds."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.importance import mean_importance, placed_rows
from foldwright.operators.metrics import importance_rollup, rmse_by, score_summary
from foldwright.operators.models import with_vector
from foldwright.operators.splits import training_rows, validation_rows
from foldwright.operators.trees import tree_importance_of
from foldwright.session import stored
from foldwright.sources.logs import append_runs


def cross_validate(
    df: DataFrame, features: list[str], make: Callable[[], object], folds: int, parallelism: int = 4
) -> list[tuple]:
    """[(fold, model, validation predictions)]: one fit per fold on the rows outside it and the holdout.

    The fits do not depend on each other; `parallelism` of them share the cluster.
    """
    prepared = with_vector(df, features)

    def fit(fold: int) -> tuple:
        model = make().fit(training_rows(prepared, fold))
        return fold, model, model.transform(validation_rows(prepared, fold))

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(fit, range(folds)))


def fold_scores(fitted: list, target: str, prediction: str = "prediction") -> DataFrame:
    """(fold, rmse) of a cross-validation."""
    return reduce(DataFrame.unionByName, [rmse_by(predicted, target, prediction, "fold") for _, _, predicted in fitted])


def holdout_score(df: DataFrame, features: list[str], target: str, make: Callable[[], object]) -> float:
    """RMSE on the holdout of a model of all other rows."""
    prepared = with_vector(df, features)
    model = make().fit(prepared.where(~F.col("holdout")))
    return rmse_by(model.transform(prepared.where("holdout")), target, "prediction").first()["rmse"]


def fold_importances(
    df: DataFrame, fitted: list, key: str, features: list[str], target: str, repeats: int, seed: int
) -> DataFrame:
    """(fold, feature, importance, std) on each fold's validation rows, which are permuted inside their fold."""
    placed = placed_rows(df.where(~F.col("holdout")), key, features, target, seed, ["fold"])
    parts = []
    for fold, model, _ in fitted:
        rows = placed.where(F.col("fold") == fold)
        parts.append(tree_importance_of(rows, features, model, repeats, seed, ["fold"]))
    return mean_importance(reduce(DataFrame.unionByName, parts), "fold")


def decide(importances: DataFrame, folds_needed: int) -> DataFrame:
    """The roll-up over folds with `kept`: false where too many folds saw no use in a feature."""
    return importance_rollup(importances).withColumn("kept", F.col("non_positive_folds") < folds_needed)


def eliminate(
    df: DataFrame,
    key: str,
    features: list[str],
    target: str,
    make: Callable[[], object],
    folds: int,
    log_path: str,
    repeats: int = 3,
    folds_needed: int = 4,
    seed: int = 0,
    run_id: str = "run",
    max_rounds: int | None = None,
) -> DataFrame:
    """(round, feature, total_importance, non_positive_folds, ..., kept) of all rounds until nothing is dropped.

    Every round fits, scores and permutes on the cluster; only one row per feature
    comes back. Each round adds its scores and the model's settings to the run log under `run_id`. At most
    `max_rounds` rounds run, where given; one round with 2 folds is the one-shot rule.
    """
    spark = df.sparkSession
    names, rounds = list(features), []
    rows = stored(df.select(key, *names, target, "fold", "holdout"))
    while names:
        number = len(rounds)
        test = holdout_score(rows, names, target, make)
        fitted = cross_validate(rows, names, make, folds)
        scores = score_summary(fold_scores(fitted, target)).first()
        decided = decide(fold_importances(rows, fitted, key, names, target, repeats, seed), folds_needed)
        found = [(number, *row) for row in decided.collect()]
        rounds.extend([found])
        estimator = make()
        settings = {p.name: str(v) for p, v in estimator.extractParamMap().items()}
        params = {type(estimator).__name__: settings}
        log = [("elimination", run_id, number, names, params, scores["mean_rmse"], scores["std_rmse"], test, len(names))]
        schema = (
            "experiment string, run_id string, round int, features array<string>, "
            "params map<string,map<string,string>>, mean_rmse double, std_rmse double, test_rmse double, n_features int"
        )
        append_runs(spark.createDataFrame(log, schema), log_path)
        kept = {row[1] for row in found if row[-1]}
        if len(kept) == len(names) or len(rounds) == max_rounds:
            break
        names = [n for n in names if n in kept]
    columns = (
        "round int, feature string, total_importance double, non_positive_folds bigint, mean_importance double, "
        "std_importance double, kept boolean"
    )
    return spark.createDataFrame([row for found in rounds for row in found], columns)
