"""Importance, elimination and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.numeric import hash_fold
from foldwright.operators import elimination, importance, metrics, models, trees
from foldwright.operators.rowindex import split_by_order
from foldwright.plans.inputs import (
    FOLDS,
    INTERCEPT,
    MEASURES,
    ORDER_MEASURES,
    SEED,
    TARGET,
    WEIGHTS,
    order_measures,
    sql_hash32,
    table,
)
from foldwright.plans.registry import query
from foldwright.session import scratch_path, stored

# Small trees: enough to beat the mean predictor, quick enough to run every round.
SMALL = {"n_estimators": 5, "iterations": 5, "max_depth": 4, "depth": 4}
REPEATS = 3


def _sql_prediction(own: str, donor: str | None = None) -> str:
    """The fixed linear prediction, with feature f taken from the donor."""
    terms = [f"{INTERCEPT}::double"]
    for i, (name, weight) in enumerate(zip(MEASURES, WEIGHTS)):
        value = f"{own}.{name}" if donor is None else f"case when f = {i} then {donor}.{name} else {own}.{name} end"
        terms.append(f"({weight}::double) * ({value})")
    return " + ".join(terms)


def _sql_importance(group: str) -> str:
    """Importance per `group`, feature and repeat, as the library defines it."""
    names = "['" + "', '".join(MEASURES) + "']"
    return f"""
    with m as ({ORDER_MEASURES}),
    p as (select *, {group} as g,
            row_number() over (partition by {group} order by md5(l_orderkey::varchar || '|{SEED}'), l_orderkey) as place,
            count(*) over (partition by {group}) as n from m where not holdout),
    v as (select *, unnest(range({REPEATS})) as repeat from p),
    s as (select v.*, (place - 1 + {sql_hash32(str(SEED), 'repeat')} % (n - 1) + 1) % n + 1 as donor from v),
    x as (select a.g, f, a.repeat, a.total_price as y, {_sql_prediction('a', 'b')} as permuted, {_sql_prediction('a')} as plain
        from s a join p b on b.g = a.g and b.place = a.donor cross join (select unnest(range({len(MEASURES)})) as f))
    select g as fold, {names}[f + 1] as feature, repeat,
        sqrt(avg((y - permuted) * (y - permuted))) - sqrt(avg((y - plain) * (y - plain))) as importance
    from x group by 1, 2, 3
    """


def _linear_importance(spark: SparkSession, sf_dir: str, within: list[str]) -> DataFrame:
    rows = order_measures(spark, sf_dir).where(~F.col("holdout"))
    scorer = importance.linear_scorer(WEIGHTS, INTERCEPT)
    return importance.permutation_importance(rows, "l_orderkey", MEASURES, TARGET, scorer, REPEATS, SEED, within)


@query(
    f"""select feature, round(avg(importance), 4) as importance, round(stddev_pop(importance), 4) as std
    from ({_sql_importance('0')}) group by 1"""
)
def permutation_importance_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.mean_importance(_linear_importance(spark, sf_dir, []))
    return found.select("feature", F.round("importance", 4).alias("importance"), F.round("std", 4).alias("std"))


@query(
    f"""with i as (select fold, feature, avg(importance) as importance from ({_sql_importance('fold')}) group by 1, 2)
    select feature, round(coalesce(sum(importance) filter (importance > 0), 0), 4) as total_importance,
        count(*) filter (importance <= 0) as non_positive_folds, count(*) filter (importance <= 0) < 4 as kept
    from i group by 1"""
)
def feature_elimination_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.mean_importance(_linear_importance(spark, sf_dir, ["fold"]), "fold")
    return elimination.decide(found, 4).select(
        "feature", F.round("total_importance", 4).alias("total_importance"), "non_positive_folds", "kept"
    )


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order measures as a stored table: every fit reads them again."""
    return stored(order_measures(spark, sf_dir))


def _small_tree():
    return models.boosted({**models.SELECTION_SETTINGS, "n_estimators": 3, "max_depth": 3}, TARGET, SEED)


@query()
def cv_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE of a boosted model per fold, beside that of the mean of the training rows."""
    rows = _prepared(spark, sf_dir)
    fitted = elimination.cross_validate(rows, MEASURES, _small_tree, FOLDS)
    scores = elimination.fold_scores(fitted, TARGET)
    kept = rows.where(~F.col("holdout")).withColumn("all", F.lit(1))
    means = metrics.rmse_by(metrics.out_of_fold_means(kept, "fold", "all", TARGET), TARGET, "prediction", "fold")
    return scores.join(means.withColumnRenamed("rmse", "mean_rmse"), "fold")


@query()
def boosted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout RMSE of the three boosted configurations, beside the deviation of the target."""
    rows = models.with_vector(_prepared(spark, sf_dir), MEASURES)
    test = rows.where("holdout")
    fitted = models.fit_members(models.boosted_members(TARGET, SEED, SMALL), rows.where(~F.col("holdout")))
    scored = models.ensemble_predict(fitted, test)
    families = list(models.BOOSTED_SETTINGS)
    scores = scored.agg(
        *[metrics.rmse(F.col(TARGET), F.col(f"prediction_{f}")).alias(f) for f in families],
        F.stddev_pop(TARGET).alias("deviation"),
    )
    return scores.unpivot("deviation", families, "model", "rmse")


@query()
def ensemble_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout predictions of the averaged ensemble."""
    rows = models.with_vector(_prepared(spark, sf_dir), MEASURES)
    members = [*models.boosted_members(TARGET, SEED, SMALL), models.forest(TARGET, SEED, 5, 4, "prediction_forest")]
    fitted = models.fit_members(members, rows.where(~F.col("holdout")))
    return models.ensemble_predict(fitted, rows.where("holdout")).select("l_orderkey", TARGET, "prediction")


@query()
def permutation_importance_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance on the holdout for a boosted model of the other rows."""
    rows = _prepared(spark, sf_dir)
    model = _small_tree().fit(models.with_vector(rows.where(~F.col("holdout")), MEASURES))
    placed = importance.placed_rows(rows.where("holdout"), "l_orderkey", MEASURES, TARGET, SEED)
    return importance.mean_importance(trees.tree_importance_of(placed, MEASURES, model, 5, SEED))


@query(
    f"""select feature, true as same_as_rescoring
    from (select unnest([{", ".join(f"'{m}'" for m in MEASURES)}]) as feature)"""
)
def tree_importance_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rescoring only the trees that a feature is in gives what rescoring all of them gives."""
    rows = _prepared(spark, sf_dir)
    model = _small_tree().fit(models.with_vector(rows.where(~F.col("holdout")), MEASURES))
    placed = importance.placed_rows(rows.where("holdout"), "l_orderkey", MEASURES, TARGET, SEED)
    fast = trees.tree_importance_of(placed, MEASURES, model, REPEATS, SEED)
    whole = importance.importance_of(placed, MEASURES, importance.model_scorer(model), REPEATS, SEED)
    both = fast.join(whole.withColumnRenamed("importance", "whole"), ["feature", "repeat"], "full")
    near = F.abs(F.col("importance") - F.col("whole")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("whole"))
    return both.groupBy("feature").agg(F.bool_and(F.coalesce(near, F.lit(False))).alias("same_as_rescoring"))


PATIENCE = 5
BUDGET = 30


@query(f"select {BUDGET} as budget, true as stop_follows_rule, true as cut_agrees, true as loaded_agrees")
def patient_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosting cut to its best prefix by patience on fold 0, saved and loaded, and whether all of that agrees.

    30 trees of depth 4; the settings' own 200 trees of depth 10 are `patient_boosting` without overrides.
    """
    rows = stored(models.with_vector(order_measures(spark, sf_dir).where(~F.col("holdout")), MEASURES))
    validation = rows.where("fold = 0")
    settings = models.BOOSTED_SETTINGS["cb"]
    model, curve = trees.patient_boosting(
        rows.where("fold <> 0"), validation, settings, TARGET, SEED, PATIENCE, iterations=BUDGET, depth=4
    )
    loaded = models.save_and_load(model)
    reached = curve.where(F.col("trees") == model.getNumTrees).select("rmse").scalar()
    error = lambda m: metrics.rmse_by(m.transform(validation), TARGET, "prediction").select("rmse").scalar()
    # The same stop by a walk along the curve, which has one row a tree.
    errors = [r["rmse"] for r in curve.orderBy("trees").collect()]
    best = [min(range(n + 1), key=errors.__getitem__) for n in range(len(errors))]
    stop = next((n + 1 for n in range(len(errors)) if n - best[n] >= PATIENCE), len(errors))
    seen = curve.agg(F.max(F.when(F.col("seen"), F.col("trees"))).alias("seen"), F.max("trees").alias("budget"))
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.abs(b)
    return seen.select(
        "budget",
        (F.col("seen") == stop).alias("stop_follows_rule"),
        near(error(model), reached).alias("cut_agrees"),
        near(error(loaded), reached).alias("loaded_agrees"),
    )


@query()
def feature_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rounds of elimination with a boosted model."""
    log = scratch_path(spark, "elimination")
    rows = order_measures(spark, sf_dir)
    return elimination.eliminate(rows, "l_orderkey", MEASURES, TARGET, _small_tree, FOLDS, log, repeats=3, seed=SEED)


@query()
def param_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of a seeded random search; depth is kept small here."""
    rows = models.with_vector(_prepared(spark, sf_dir).where(~F.col("holdout")), MEASURES)
    ranges = {**models.SEARCH_RANGES["xgb"], "max_depth": ("int", 2, 4)}
    settings = models.draw_settings(ranges, 3, SEED)

    def build(trial: dict):
        return models.boosted(trial, TARGET, SEED, n_estimators=2)

    return models.search(rows, build, settings, TARGET, "fold", FOLDS)


@query()
def rbf_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel regression of a curve over embeddings: fitted on four of five folds, predicted for all."""
    first, second = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", (F.sin(5 * first) + second).alias("target"), hash_fold(F.col("vec_id"), FOLDS, SEED).alias("fold")
    )
    scored = models.rbf_regression(rows.where("fold <> 0"), rows, "embedding", "target", 64, 256, 1.0, 1e-4, SEED)
    return scored.select("vec_id", "fold", "target", "prediction")


@query()
def early_stopped_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees kept and validation RMSE of boosting that stops when fold 0 no longer improves."""
    rows = models.with_vector(_prepared(spark, sf_dir).where(~F.col("holdout")), MEASURES)
    flagged = rows.withColumn("validation", F.col("fold") == 0)
    settings = models.BOOSTED_SETTINGS["cb"]
    estimator = models.early_stopped(settings, TARGET, SEED, "validation", 0.001, iterations=12, depth=4)
    model = estimator.fit(flagged)
    scores = metrics.rmse_by(model.transform(flagged.where("validation")), TARGET, "prediction")
    return scores.withColumn("trees", F.lit(model.getNumTrees))


@query()
def ordered_holdout_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE of the averaged ensemble on the last fifth by key, fitted on the rest."""
    rows = models.with_vector(split_by_order(_prepared(spark, sf_dir), ["l_orderkey"], 0.8), MEASURES)
    fitted = models.fit_members(models.boosted_members(TARGET, SEED, SMALL), rows.where("split = 'head'"))
    scored = models.ensemble_predict(fitted, rows.where("split = 'tail'"))
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        metrics.rmse(F.col(TARGET), F.col("prediction")).alias("rmse"),
        F.stddev_pop(TARGET).alias("deviation"),
    )
