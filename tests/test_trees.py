import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import importance, models, trees


@pytest.fixture(scope="module")
def rows(spark):
    value = lambda n, m: (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(m))).cast("double")
    df = spark.range(600).select("id", value(1, 20).alias("a"), value(2, 7).alias("b"), value(3, 5).alias("idle"))
    df = df.withColumn("y", F.col("a") * F.col("a") - 3 * F.col("b")).withColumn("fold", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    return models.with_vector(df, ["a", "b", "idle"])


@pytest.fixture(scope="module")
def model(rows):
    return models.boosted({"n_estimators": 6, "max_depth": 2, "learning_rate": 0.3}, "y", 1).fit(rows)


def test_outputs_add_up_to_predictions(rows, model):
    own = trees.Trees.of(model)
    found = rows.select("a", "b", "idle").toPandas().to_numpy()
    expected = model.transform(rows).select("prediction").toPandas().prediction
    assert np.abs(own.outputs(found, np.arange(6)).sum(1) - expected).max() < 1e-9
    assert len(own.splitting_on(0)) == 6 and len(own.splitting_on(2)) == 0


@pytest.mark.parametrize("within", [[], ["fold"]])
def test_importance_equals_full_rescoring(rows, model, within):
    features = ["a", "b", "idle"]
    placed = importance.placed_rows(rows, "id", features, "y", 3, within)
    by = lambda df: {tuple(r[c] for c in (*within, "feature", "repeat")): r["importance"] for r in df.collect()}
    fast = by(trees.tree_importance_of(placed, features, model, 4, 3, within))
    whole = by(importance.importance_of(placed, features, importance.model_scorer(model), 4, 3, within))
    assert fast.keys() == whole.keys() and len(fast) == 12 * (3 if within else 1)
    assert all(abs(fast[k] - whole[k]) < 1e-9 for k in fast)
    assert all(v == 0 for k, v in fast.items() if k[-2] == "idle")


def test_curve_is_that_of_every_prefix(rows, model):
    curve = {r["trees"]: r["rmse"] for r in trees.prefix_errors(model, rows).collect()}
    assert sorted(curve) == [1, 2, 3, 4, 5, 6]
    for n in (1, 4, 6):
        cut = trees.cut_to(model, n)
        error = cut.transform(rows).select(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0]
        assert cut.getNumTrees == n and abs(error - curve[n]) < 1e-9
    loaded = models.save_and_load(trees.cut_to(model, 4))
    assert loaded.transform(rows).select("prediction").collect() == trees.cut_to(model, 4).transform(rows).select("prediction").collect()


@pytest.mark.parametrize(
    "errors,patience,kept,seen",
    [([5, 4, 3], 2, 3, 3), ([5, 4, 6, 7, 1], 2, 2, 4), ([5, 4, 6, 3, 7, 8], 2, 4, 6), ([5, 5, 5], 2, 1, 3), ([9], 1, 1, 1), ([3, 4, 1], 1, 1, 2)],
)
def test_patience(spark, errors, patience, kept, seen):
    curve = spark.createDataFrame([(i + 1, float(e)) for i, e in enumerate(errors)], "trees int, rmse double")
    assert trees.best_prefix(curve, patience) == kept
    assert trees.with_patience(curve, patience).where("seen").count() == seen
