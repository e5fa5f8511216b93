"""Regression models on MLlib: boosted configurations, ensembles, search, kernel regression."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.session import scratch_path

# Tuned settings of the three boosted members, by family.
BOOSTED_SETTINGS = {
    "lgb": {
        "learning_rate": 0.08323424641333231,
        "n_estimators": 300,
        "max_depth": 8,
        "subsample": 0.7178970226547821,
        "colsample_bytree": 0.8410522505616279,
        "min_child_samples": 27,
    },
    "xgb": {
        "learning_rate": 0.0570718601460729,
        "n_estimators": 300,
        "max_depth": 10,
        "subsample": 0.8977779092288535,
        "colsample_bytree": 0.71785867753211,
        "min_child_weight": 9,
        "gamma": 7.977924974233929e-05,
    },
    "cb": {
        "learning_rate": 0.1575265989034749,
        "iterations": 200,
        "depth": 10,
        "subsample": 0.6031520424053429,
        "min_data_in_leaf": 48,
    },
}

# The settings of the second round of tuning.
RETUNED_SETTINGS = {
    "lgb": {
        "learning_rate": 0.0797353804621146,
        "n_estimators": 300,
        "max_depth": 10,
        "subsample": 0.8844130355984797,
        "colsample_bytree": 0.7496776024413567,
        "min_child_samples": 28,
    },
    "xgb": {
        "learning_rate": 0.04295644158857834,
        "n_estimators": 300,
        "max_depth": 12,
        "subsample": 0.9892562382056205,
        "colsample_bytree": 0.6111019695387455,
        "min_child_weight": 7,
        "gamma": 4.035214354166009e-05,
    },
    "cb": {"learning_rate": 0.07859844386492268, "iterations": 200, "depth": 12, "min_data_in_leaf": 403},
}

# Settings of the model that judges features.
SELECTION_SETTINGS = {"learning_rate": 0.03, "n_estimators": 200, "max_depth": 8}

# Search ranges of the three families.
SEARCH_RANGES = {
    "lgb": {
        "learning_rate": ("log", 0.04, 0.15),
        "max_depth": ("int", 7, 10),
        "subsample": ("uniform", 0.6, 0.9),
        "colsample_bytree": ("uniform", 0.6, 1.0),
        "min_child_samples": ("int", 20, 40),
    },
    "xgb": {
        "learning_rate": ("log", 0.01, 0.3),
        "max_depth": ("int", 3, 10),
        "subsample": ("uniform", 0.6, 1.0),
        "colsample_bytree": ("uniform", 0.6, 1.0),
        "min_child_weight": ("int", 1, 10),
        "gamma": ("log", 1e-8, 1.0),
    },
    "cb": {
        "learning_rate": ("log", 0.05, 0.2),
        "depth": ("int", 9, 11),
        "subsample": ("uniform", 0.5, 1.0),
        "min_data_in_leaf": ("int", 20, 100),
    },
}

# The ranges that the second round changed.
RETUNED_RANGES = {
    **SEARCH_RANGES,
    "xgb": {**SEARCH_RANGES["xgb"], "max_depth": ("int", 6, 12)},
    "cb": {"learning_rate": ("log", 0.05, 0.2), "depth": ("int", 9, 13), "min_data_in_leaf": ("int", 20, 500)},
}

# What a setting is called in MLlib. With squared error every row weighs 1, so a
# minimum child weight is a minimum number of rows. Leaf count and L2 penalty have
# no counterpart and are not accepted.
_MLLIB_NAMES = {
    "learning_rate": "stepSize",
    "n_estimators": "maxIter",
    "iterations": "maxIter",
    "max_depth": "maxDepth",
    "depth": "maxDepth",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "min_child_samples": "minInstancesPerNode",
    "min_data_in_leaf": "minInstancesPerNode",
    "min_child_weight": "minInstancesPerNode",
    "gamma": "minInfoGain",
}


def with_vector(df: DataFrame, features: list[str], name: str = "vector") -> DataFrame:
    """Add the feature vector; rows with a NULL or NaN feature are refused by the model, not dropped here."""
    return df.withColumn(name, array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in features])))


def boosted(settings: dict, target: str, seed: int, prediction: str = "prediction", **overrides) -> GBTRegressor:
    """A boosted-tree regressor from settings under their usual names."""
    given = {**settings, **overrides}
    params = {}
    for name, value in given.items():
        mllib = _MLLIB_NAMES[name]
        params[mllib] = str(value) if mllib == "featureSubsetStrategy" else value
    return GBTRegressor(featuresCol="vector", labelCol=target, predictionCol=prediction, seed=seed, **params)


def boosted_members(target: str, seed: int, overrides: dict | None = None, tuned: dict | None = None) -> list:
    """The three boosted configurations, each predicting into its own column."""
    members = []
    for i, (family, settings) in enumerate((tuned or BOOSTED_SETTINGS).items()):
        changes = {k: v for k, v in (overrides or {}).items() if k in settings}
        members.append(boosted(settings, target, seed + i, f"prediction_{family}", **changes))
    return members


def forest(target: str, seed: int, trees: int, depth: int, prediction: str) -> RandomForestRegressor:
    """A bagged member that errs differently from the boosted ones."""
    return RandomForestRegressor(
        featuresCol="vector", labelCol=target, predictionCol=prediction, numTrees=trees, maxDepth=depth, seed=seed
    )


def average_of(columns: list[str]) -> Column:
    """Plain mean of prediction columns."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / F.lit(len(columns))


def ensemble_predict(models: list[Model], df: DataFrame, name: str = "prediction") -> DataFrame:
    """Predictions of every model in one pass over the rows, and their mean.

    Models that share a prediction column, such as those of the folds, are told apart by number.
    """
    names = [m.getPredictionCol() for m in models]
    if len(set(names)) < len(names):
        names = [f"{n}_{i}" for i, n in enumerate(names)]
    out = df
    for model, column in zip(models, names):
        out = model.copy().setPredictionCol(column).transform(out)
    return out.withColumn(name, average_of(names))


def fit_members(members: list, train: DataFrame, parallelism: int = 3) -> list[Model]:
    """Fit independent members side by side; `train` should be a stored table, as each of them reads it."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda member: member.fit(train), members))


def draw_settings(ranges: dict, trials: int, seed: int) -> list[dict]:
    """Settings for each trial, drawn independently from the declared ranges."""
    rng = random.Random(seed)

    def draw(kind: str, low: float, high: float):
        if kind == "int":
            return rng.randint(low, high)
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.uniform(low, high)

    return [{name: draw(*spec) for name, spec in ranges.items()} for _ in range(trials)]


def search(
    df: DataFrame,
    build: Callable[[dict], object],
    settings: list[dict],
    target: str,
    fold: str,
    folds: int,
    parallelism: int = 4,
) -> DataFrame:
    """(trial, params, score): mean RMSE over the folds of each trial; `build` makes the estimator.

    `parallelism` fits run side by side, one for each trial and fold; nothing is fitted beyond those.
    `df` should be a stored table with the `vector` column.
    """
    parts = [(df.where(F.col(fold) != f), df.where(F.col(fold) == f)) for f in range(folds)]

    def error(task: tuple[int, int]) -> float:
        estimator = build(settings[task[0]])
        train, test = parts[task[1]]
        evaluator = RegressionEvaluator(labelCol=target, predictionCol=estimator.getPredictionCol(), metricName="rmse")
        return evaluator.evaluate(estimator.fit(train).transform(test))

    tasks = [(trial, f) for trial in range(len(settings)) for f in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        errors = list(pool.map(error, tasks))
    scores = [sum(errors[i * folds : (i + 1) * folds]) / folds for i in range(len(settings))]
    trials = [
        (i, {k: float(v) for k, v in s.items()}, float(score)) for i, (s, score) in enumerate(zip(settings, scores))
    ]
    return df.sparkSession.createDataFrame(trials, "trial int, params map<string,double>, score double")


def search_families(
    df: DataFrame,
    target: str,
    fold: str,
    folds: int,
    seed: int,
    trials: int = 200,
    ranges: dict[str, dict] | None = None,
    overrides: dict | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """(family, trial, params, score): `search` over every family, by default over all of `SEARCH_RANGES`.

    The budget is `trials` draws a family, each fitted once a fold with as many trees as the family's
    `BOOSTED_SETTINGS` have. `overrides` replaces settings of the families that have them, such as the number
    of trees, for a smaller run.
    """
    found = []
    for i, (family, own) in enumerate((ranges or SEARCH_RANGES).items()):
        fixed = {k: v for k, v in BOOSTED_SETTINGS[family].items() if k in ("n_estimators", "iterations")}
        fixed |= {k: v for k, v in (overrides or {}).items() if k in fixed}
        held = {k: v for k, v in (overrides or {}).items() if k in own}
        settings = [{**drawn, **held} for drawn in draw_settings(own, trials, seed + i)]
        scored = search(df, lambda s, fixed=fixed: boosted(s, target, seed, **fixed), settings, target, fold, folds, parallelism)
        found.append(scored.select(F.lit(family).alias("family"), "*"))
    return reduce(DataFrame.unionByName, found)


def save_and_load(model: GBTRegressionModel) -> GBTRegressionModel:
    """Write a fitted model to the shared folder and read it back."""
    from pyspark.sql import SparkSession

    path = scratch_path(SparkSession.active(), f"model_{model.uid}")
    model.write().overwrite().save(path)
    return GBTRegressionModel.load(path)


def early_stopped(settings: dict, target: str, seed: int, validation: str, tolerance: float, **overrides) -> GBTRegressor:
    """Boosting that stops once the error on rows flagged by `validation` no longer falls by `tolerance`."""
    estimator = boosted(settings, target, seed, **overrides).setValidationIndicatorCol(validation)
    return estimator.copy({estimator.validationTol: tolerance})


def fourier_features(length: int, count: int, scale: float, seed: int):
    """Random Fourier features of an RBF kernel (Rahimi and Recht, 2007) as an array expression."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, 1.0 / scale, (length, count))
    phases = rng.uniform(0.0, 2 * math.pi, count)

    @F.pandas_udf("array<double>")
    def features(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        stacked = np.stack(vectors.to_numpy()).astype(float)
        return pd.Series(list(math.sqrt(2.0 / count) * np.cos(stacked @ weights + phases)))

    return features


def rbf_regression(
    train: DataFrame, rows: DataFrame, vector: str, target: str, length: int, count: int, scale: float, noise: float, seed: int
) -> DataFrame:
    """`rows` with the posterior mean of a Gaussian process with an RBF kernel, by random features.

    The ridge solution over the features comes from one pass of summed products.
    """
    features = fourier_features(length, count, scale, seed)

    def mapped(df: DataFrame) -> DataFrame:
        return df.withColumn("vector", array_to_vector(features(F.col(vector))))

    ridge = LinearRegression(
        featuresCol="vector", labelCol=target, solver="normal", regParam=noise, standardization=False
    )
    return ridge.fit(mapped(train)).transform(mapped(rows)).drop("vector")
