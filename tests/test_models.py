import pytest
from pyspark.sql import functions as F

from foldwright.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * 3 - F.col("b")).withColumn("fold", (F.col("id") % 3).cast("int"))
    return models.with_vector(df, ["a", "b"])


def test_settings_by_their_usual_names():
    one = models.boosted(models.BOOSTED_SETTINGS["xgb"], "y", 1)
    assert (one.getMaxIter(), one.getMaxDepth(), one.getMinInstancesPerNode()) == (300, 10, 9)
    assert one.getStepSize() == pytest.approx(0.0570718601460729)
    with pytest.raises(KeyError):
        models.boosted({"num_leaves": 3}, "y", 1)


def test_draws_stay_in_range_and_repeat():
    for ranges in models.SEARCH_RANGES.values():
        drawn = models.draw_settings(ranges, 50, 4)
        assert drawn == models.draw_settings(ranges, 50, 4) != models.draw_settings(ranges, 50, 5)
        for trial in drawn:
            assert all(ranges[n][1] <= v <= ranges[n][2] for n, v in trial.items())


def test_ensemble_is_the_mean(spark, rows):
    members = models.boosted_members("y", 1, {"n_estimators": 2, "iterations": 2, "max_depth": 3, "depth": 3})
    fitted = models.fit_members(members, rows)
    for r in models.ensemble_predict(fitted, rows).limit(20).collect():
        assert r["prediction"] == pytest.approx((r["prediction_lgb"] + r["prediction_xgb"] + r["prediction_cb"]) / 3)


def test_fold_models_share_a_column(spark, rows):
    fitted = [models.boosted({"n_estimators": 1, "max_depth": d}, "y", 1).fit(rows) for d in (1, 3)]
    for r in models.ensemble_predict(fitted, rows).limit(20).collect():
        assert r["prediction"] == pytest.approx((r["prediction_0"] + r["prediction_1"]) / 2)


def test_search_scores_every_trial(spark, rows):
    def build(settings):
        return models.boosted(settings, "y", 1, n_estimators=2)

    trials = models.search(rows, build, [{"max_depth": 1}, {"max_depth": 4}], "y", "fold", 3).collect()
    assert [r["trial"] for r in trials] == [0, 1]
    assert trials[1]["score"] < trials[0]["score"]


def test_search_covers_the_families(spark, rows):
    few = {"n_estimators": 1, "iterations": 1, "max_depth": 2, "depth": 2}
    found = models.search_families(rows, "y", "fold", 3, 4, trials=2, overrides=few).collect()
    assert [(r["family"], r["trial"]) for r in found] == [(f, i) for f in ("lgb", "xgb", "cb") for i in (0, 1)]
    for r in found:
        assert set(r["params"]) == set(models.SEARCH_RANGES[r["family"]]) and r["score"] > 0
        assert r["params"].get("depth", r["params"].get("max_depth")) == 2


def test_search_runs_the_whole_budget_by_default(spark, monkeypatch):
    asked = []

    def noted(df, build, settings, *args):
        asked.append((len(settings), build(settings[0]).getMaxIter()))
        return spark.createDataFrame([], "trial int, params map<string,double>, score double")

    monkeypatch.setattr(models, "search", noted)
    models.search_families(None, "y", "fold", 5, 4)
    assert asked == [(200, 300), (200, 300), (200, 200)]


def test_saved_model_predicts_the_same(spark, rows):
    model = models.boosted({"n_estimators": 2, "max_depth": 2}, "y", 1).fit(rows)
    loaded = models.save_and_load(model)
    assert loaded.transform(rows).select("prediction").collect() == model.transform(rows).select("prediction").collect()
