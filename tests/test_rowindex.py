from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldwright.operators import importance, metrics, rowindex


def test_row_index_counts_from_one(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    found = rowindex.with_row_index(df, [F.desc("g"), "k"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in found] == list(range(1, 5001))
    assert [(r["g"], r["k"]) for r in found] == sorted(((r["g"], r["k"]) for r in found), key=lambda p: (-p[0], p[1]))


def test_empty_input(spark):
    df = spark.range(0)
    assert rowindex.with_row_index(df, ["id"]).count() == 0
    assert rowindex.with_seeded_position(df, "id", 1).count() == 0


def test_seeded_position_ignores_partitioning(spark):
    df = spark.range(1000)
    first = {r["id"]: r["position"] for r in rowindex.with_seeded_position(df, "id", 3).collect()}
    second = {r["id"]: r["position"] for r in rowindex.with_seeded_position(df.repartition(7), "id", 3).collect()}
    other = {r["id"]: r["position"] for r in rowindex.with_seeded_position(df, "id", 4).collect()}
    assert first == second != other
    assert sorted(first.values()) == list(range(1, 1001))


def test_positions_within_a_hot_group(spark):
    df = spark.range(900).withColumn("g", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 5))
    found = rowindex.with_seeded_position(df, "id", 3, within=["g"]).collect()
    sizes = Counter(r["g"] for r in found)
    for g, n in sizes.items():
        assert sorted(r["position"] for r in found if r["g"] == g) == list(range(1, n + 1))


def test_permutation_keeps_the_column(spark):
    df = spark.range(500).withColumn("x", F.col("id") % 7)
    got = rowindex.permuted_column(df, "id", "x", 5, "y").collect()
    assert len(got) == 500
    assert Counter(r["y"] for r in got) == Counter(r["x"] for r in got)
    assert any(r["x"] != r["y"] for r in got)


@pytest.mark.parametrize("rows", [0, 1, 4, 5, 11])
def test_head_share(spark, rows):
    found = rowindex.split_by_order(spark.range(rows), ["id"], 0.8)
    head = [r["id"] for r in found.where("split = 'head'").collect()]
    assert sorted(head) == list(range(int(rows * 0.8)))
    assert found.count() == rows


def test_batches(spark):
    df = rowindex.with_batch(rowindex.with_seeded_position(spark.range(250), "id", 1), "position", 100)
    assert {r["batch_id"]: r["count"] for r in df.groupBy("batch_id").count().collect()} == {0: 100, 1: 100, 2: 50}


def test_importance_against_plain_python(spark):
    rows = [(i, float(i % 13), float(i % 5), 3.0 * (i % 13) + (i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, used double, unused double, y double")
    scorer = importance.linear_scorer([3.0, 0.0])
    found = importance.permutation_importance(df, "id", ["used", "unused"], "y", scorer, 2, 9).collect()
    by = {(r["feature"], r["repeat"]): r["importance"] for r in found}
    assert len(by) == 4
    assert by["unused", 0] == by["unused", 1] == 0.0
    places = {r["id"]: r["position"] for r in rowindex.with_seeded_position(df, "id", 9).collect()}
    at = {p: i for i, p in places.items()}
    shifts = {
        r["repeat"]: r["s"]
        for r in spark.range(2).select(F.col("id").cast("int").alias("repeat"))
        .select("repeat", importance.shift(F.lit(120), 9, F.col("repeat")).alias("s")).collect()
    }
    for repeat, step in shifts.items():
        assert 1 <= step < 120
        permuted = [(3.0 * rows[at[(places[i] - 1 + step) % 120 + 1]][1], y) for i, _, _, y in rows]
        plain = [(3.0 * x, y) for _, x, _, y in rows]
        score = [(sum((p - y) ** 2 for p, y in pairs) / 120) ** 0.5 for pairs in (permuted, plain)]
        assert by["used", repeat] == pytest.approx(score[0] - score[1])


def test_importance_of_single_row_groups(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 5.0), (2, 1, 3.0, 1.0)], "id bigint, fold int, x double, y double")
    found = importance.permutation_importance(df, "id", ["x"], "y", importance.linear_scorer([1.0]), 2, 1, ["fold"])
    assert [r["importance"] for r in found.collect()] == [0.0] * 4


def test_best_trial_skips_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, 0.5), (4, None)], "trial int, score double")
    assert tuple(metrics.best_by(df, "score", "trial", "score").first()) == (2, 0.5)


def test_null_groups_are_kept(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), F.col("id").cast("double").alias("x"))
    placed = rowindex.with_seeded_position(df, "id", 1, "p", ["g"])
    assert sorted(r["p"] for r in placed.where("g is null").collect()) == list(range(1, 11)) and placed.count() == 40
    means = metrics.out_of_fold_means(df.withColumn("c", F.lit("a")), "g", "c", "x")
    assert means.count() == 40 and means.where("prediction is null").isEmpty()
    scorer = importance.linear_scorer([1.0])
    found = importance.permutation_importance(df, "id", ["x"], "x", scorer, 2, 1, ["g"])
    assert found.count() == 8 and found.where("g is null").count() == 2
