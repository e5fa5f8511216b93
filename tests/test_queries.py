"""Every registered query against its SQL, and what its plan must not hold."""

import importlib

import pytest
from compare import differences, duck

from foldwright.plans.catalog import ORACLES, QUERIES

# Queries that fit models; their results are tested in test_models.py.
FITTED = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert differences(df, connection, ORACLES[name]) == ""


@pytest.mark.parametrize("name", FITTED)
def test_fitted_query_gives_rows(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows
    for row in rows:
        for value in row:
            assert value is not None and value == value
    scores = {r["model"]: r for r in rows} if name == "boosted_regression" else {}
    for row in scores.values():
        assert row["rmse"] < row["deviation"]
    if name == "cv_tree":
        assert len(rows) == 5 and all(r["rmse"] < r["mean_rmse"] for r in rows)
    if name == "ordered_holdout_eval":
        assert rows[0]["rmse"] < rows[0]["deviation"]
    if name == "ensemble_fit":
        mean = sum(r["total_price"] for r in rows) / len(rows)
        assert sum((r["prediction"] - r["total_price"]) ** 2 for r in rows) < sum(
            (mean - r["total_price"]) ** 2 for r in rows
        )
    if name == "rbf_regression":
        tested = [r for r in rows if r["fold"] == 0]
        mean = sum(r["target"] for r in tested) / len(tested)
        assert sum((r["prediction"] - r["target"]) ** 2 for r in tested) < sum(
            (mean - r["target"]) ** 2 for r in tested
        )
    if name == "feature_elimination":
        last = max(r["round"] for r in rows)
        assert all(r["kept"] for r in rows if r["round"] == last)
    if name == "param_search":
        assert len(rows) == 3


def test_entry(spark, sf_dir):
    entry = importlib.import_module("__spark_entry__")
    rows = entry.entry(spark).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2, 3, 4]
    assert set(entry.oracle_sql()) <= set(entry.queries())
