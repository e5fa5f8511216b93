"""Fitted boosted trees as data: importance that rescores only the trees a feature is in, and best prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwright.operators.importance import met_donors
from foldwright.operators.models import boosted
from foldwright.operators.rings import matrix
from foldwright.session import scratch_path, scratch_space


@dataclass
class Trees:
    """Nodes of all trees one after the other; a leaf has feature -1 and is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(model: GBTRegressionModel) -> Trees:
        """Read from the model's own saved form; splits must be on continuous features."""
        spark = SparkSession.active()
        with scratch_space(spark):
            path = scratch_path(spark, "trees")
            model.write().save(path)
            node = F.col("nodeData")
            nodes = spark.read.parquet(f"{path}/data").select(
                "treeID", node["id"].alias("id"), node["prediction"].alias("value"), node["leftChild"].alias("left"),
                node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
                F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
                node["split"]["numCategories"].alias("categories"),
            )
            rows = nodes.orderBy("treeID", "id").toPandas()
        if (rows.categories > 0).any():
            raise ValueError("splits on categories are not supported")
        starts = np.searchsorted(rows.treeID, np.arange(len(model.treeWeights)))
        base, own = starts[rows.treeID], np.arange(len(rows))
        leaf = (rows.feature < 0).to_numpy()
        return Trees(
            rows.feature.to_numpy(), np.where(leaf, np.inf, rows.threshold.to_numpy()),
            np.where(leaf, own, base + rows.left), np.where(leaf, own, base + rows.right),
            rows.value.to_numpy(), starts, np.array(model.treeWeights),
        )

    def splitting_on(self, feature: int) -> np.ndarray:
        """Numbers of the trees that look at a feature."""
        tree = np.searchsorted(self.roots, np.flatnonzero(self.feature == feature), side="right") - 1
        return np.unique(tree)

    def outputs(self, features: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """Weighted output of each of `trees` for each row."""
        node = np.repeat(self.roots[trees][None, :], len(features), 0)
        rows = np.arange(len(features))[:, None]
        while True:
            feature = self.feature[node]
            if (feature < 0).all():
                return self.value[node] * self.weights[trees]
            goes_left = features[rows, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])


def tree_importance_of(
    placed: DataFrame, features: list[str], model: GBTRegressionModel, repeats: int, seed: int, within: list[str] | None = None
) -> DataFrame:
    """Same rows as `importance.importance_of` with the model's scorer, by rescoring the trees that change.

    A permuted feature changes only the trees that split on it. Their outputs are summed anew
    and stand in for the old ones in the prediction; a feature that no tree uses scores 0
    without looking at a row. Each task returns one row a group, repeat and feature.
    """
    groups = list(within or [])
    trees = placed.sparkSession.sparkContext.broadcast(Trees.of(model))
    met = met_donors(placed, repeats, seed, groups)
    names, kinds = [*groups, "repeat"], dict(met.dtypes)
    count = len(features)

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        every = np.arange(len(own.roots))
        uses = [own.splitting_on(f) for f in range(count)]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, donors = matrix(batch.column("_own")), matrix(batch.column("_donor"))
            target = batch.column("_target").to_numpy()
            outputs = own.outputs(rows, every)
            plain = outputs.sum(1)
            rise = np.zeros((len(rows), count))
            for f in range(count):
                if len(uses[f]):
                    swapped = rows.copy()
                    swapped[:, f] = donors[:, f]
                    moved = plain + (own.outputs(swapped, uses[f]) - outputs[:, uses[f]]).sum(1)
                    rise[:, f] = (target - moved) ** 2 - (target - plain) ** 2
            squares = pa.array((target - plain) ** 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * count), pa.array(rise.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), squares, lists], [*names, "_square", "_rise"])

    own = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    scored = met.mapInArrow(rescore, f"{own}, _square double, _rise array<double>")
    sums = [F.sum(F.get("_rise", F.lit(i))).alias(f"_rise_{i}") for i in range(count)]
    totals = scored.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.sum("_square").alias("_square"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_rise_{i}").alias("rise")) for i, f in enumerate(features)]))
    one = totals.select(*names, "_n", "_square", each.alias("_one"))
    permuted = F.sqrt((F.col("_square") + F.col("_one.rise")) / F.col("_n"))
    return one.select(*groups, "_one.feature", "repeat", (permuted - F.sqrt(F.col("_square") / F.col("_n"))).alias("importance"))


def prefix_errors(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    """(trees, rmse): error on `rows` of the first 1, 2, ... trees, all from one pass over them."""
    errors = model.evaluateEachIteration(rows, "squared")
    return rows.sparkSession.createDataFrame([(i + 1, float(e) ** 0.5) for i, e in enumerate(errors)], "trees int, rmse double")


def with_patience(curve: DataFrame, patience: int) -> DataFrame:
    """`curve` (trees, rmse) with `best_trees`, the first best prefix so far, and `seen`.

    Training by patience sees prefixes until `patience` of them in a row were no better than the best
    before; `seen` is false for those beyond. The curve has one row a tree, so one window holds it.
    """
    order = Window.orderBy("trees")
    best = F.min(F.struct("rmse", "trees")).over(order.rowsBetween(Window.unboundedPreceding, 0))["trees"]
    waits = F.col("trees") - F.col("best_trees") >= patience
    ended = F.coalesce(F.max(waits.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return curve.withColumn("best_trees", best).withColumn("seen", ended == 0)


def best_prefix(curve: DataFrame, patience: int) -> int:
    """Trees of the best prefix that training with `patience` sees; the smallest of equals."""
    seen = with_patience(curve, patience).where("seen")
    return seen.agg(F.min(F.struct("rmse", "trees"))["trees"]).first()[0]


def cut_to(model: GBTRegressionModel, trees: int) -> GBTRegressionModel:
    """A model of the first `trees` trees, which can be saved and loaded like any other."""
    context = SparkSession.active().sparkContext
    java = model._java_obj
    kinds = context._jvm.org.apache.spark.ml.regression
    held = context._gateway.new_array(kinds.DecisionTreeRegressionModel, trees)
    weights = context._gateway.new_array(context._gateway.jvm.double, trees)
    for i in range(trees):
        held[i], weights[i] = java.trees()[i], model.treeWeights[i]
    cut = GBTRegressionModel(kinds.GBTRegressionModel(f"{java.uid()}_{trees}", held, weights))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def patient_boosting(
    train: DataFrame, validation: DataFrame, settings: dict, target: str, seed: int, patience: int, **overrides
) -> tuple[GBTRegressionModel, DataFrame]:
    """(model, curve): boosting cut to the best prefix that training with `patience` would have seen.

    All trees of the settings are fitted; `curve` has the error of every prefix on `validation`, with
    `best_trees` and `seen`.
    """
    model = boosted(settings, target, seed, **overrides).fit(train)
    curve = prefix_errors(model, validation)
    return cut_to(model, best_prefix(curve, patience)), with_patience(curve, patience)
