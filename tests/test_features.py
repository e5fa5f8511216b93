import math

import pytest
from pyspark.sql import functions as F

from foldwright.functions import text as tx
from foldwright.functions.numeric import rounded_even
from foldwright.operators import encode, project


def test_agent_names(spark):
    names = ["MCTS-UCB1-0.6-NST-false", "MCTS-A-B-0.6-MAST-true", "UCT-1-2-3-4", "MCTS-X-fast-NST-true", "MCTS----", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, agent string")
    parts = df.select("i", *[c.alias(n) for n, c in tx.agent_columns(F.col("agent"), "p1").items()]).orderBy("i")
    rows = [tuple(r)[1:] for r in parts.collect()]
    assert rows[0][0] == "UCB1" and math.isclose(rows[0][1], 0.6, rel_tol=1e-6) and rows[0][2:] == ("NST", "false")
    assert rows[1][0] == "A-B" and rows[1][2:] == ("MAST", "true")
    assert rows[2] == (None,) * 4 and rows[5] == (None,) * 4
    assert rows[3] == ("X", None, "NST", "true")
    assert rows[4] == ("", None, "", "")


def test_lengths_count_characters(spark):
    row = spark.sql("select 'é😀a' as a, '' as b, cast(null as string) as c").select(
        *[tx.char_count(F.col(c)) for c in "abc"]
    ).first()
    assert tuple(row) == (3, 0, None)


def test_round_half_even(spark):
    row = spark.sql("select 0.0625D as a, 0.1875D as b").select(rounded_even(F.col("a")), rounded_even(F.col("b"))).first()
    assert tuple(row) == (0.062, 0.188)


def matches(spark, rows):
    schema = (
        "Id bigint, GameRulesetName string, agent1 string, agent2 string, NumRows int, Same int, Empty string, "
        "EnglishRules string, LudRules string"
    )
    return spark.createDataFrame(rows, schema)


def test_test_rows_get_the_training_codes(spark):
    train = matches(spark, [
        (1, "g", "MCTS-UCB1-0.6-NST-false", "MCTS-GRAVE-1.4-MAST-true", 3, 1, None, "rules", "(game)"),
        (2, "h", "MCTS-GRAVE-0.1-MAST-true", "MCTS-UCB1-0.6-NST-false", 4, 1, None, "", "é"),
        (3, "h", None, "MCTS-UCB1-0.6-NST-false", 4, 1, None, None, "x"),
    ])
    plan = encode.fit_features(train)
    assert plan.dropped == ["Same", "Empty"]
    first = encode.transform_features(train, plan)
    test = matches(spark, [(9, "z", "MCTS-NEW-0.6-NST-false", "MCTS-UCB1-0.6-NST-false", 1, 7, "x", "ab", "c")])
    second = encode.transform_features(test, plan)
    assert first.dtypes == second.dtypes
    assert "GameRulesetName" not in first.columns and "EnglishRules" not in first.columns
    coded = {r["Id"]: r for r in first.collect()}
    assert (coded[1]["p1_selection"], coded[2]["p1_selection"], coded[3]["p1_selection"]) == (1, 0, 2)
    assert (coded[2]["char_count_english"], coded[3]["char_count_english"]) == (0, None)
    row = second.first()
    assert row["p1_selection"] == 2 and row["p2_selection"] == 1 and row["agent1"] == 2


def test_one_hot_rows_sum_to_one_or_zero(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    levels = encode.category_levels(df, ["c"])
    found = {r["id"]: (r["c_a"], r["c_b"]) for r in encode.one_hot(df, levels, ["c"]).collect()}
    assert found == {1: (1, 0), 2: (0, 1), 3: (0, 0)}
    unseen = spark.createDataFrame([(4, "z")], "id int, c string")
    assert tuple(encode.one_hot(unseen, levels, ["c"]).first()) == (4, 0, 0)


def test_zero_deviation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    scored = encode.fit_standardiser(df, ["a", "b"]).apply(df)
    assert [r["a"] for r in scored.collect()] == [0.0, 0.0]


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, "x", 1.0)], "Id int, num_a int, name string, y double")
    assert project.matching(df, "^num_.*$") == ["num_a"]
    assert project.excluding(df, ["Id"], ["y", "y"]) == ["num_a", "name"]
    assert project.numeric_columns(df) == ["Id", "num_a", "y"]


def test_one_hot_names_must_differ(spark):
    df = spark.createDataFrame([(1, "b_c", "x"), (2, "d", "c")], "id int, a string, a_b string")
    levels = encode.category_levels(df, ["a", "a_b"])
    with pytest.raises(ValueError, match="a_b_c"):
        encode.one_hot(df, levels, ["a", "a_b"])
    taken = df.withColumn("A_D", F.lit(1))
    with pytest.raises(ValueError, match="a_d"):
        encode.one_hot(taken, levels, ["a"])
    found = {r["id"]: r["positions"] for r in encode.one_hot_positions(df, levels, ["a", "a_b"]).collect()}
    assert found == {1: [0, 3], 2: [1, 2]}
    names = {r["position"]: (r["column"], r["level"]) for r in encode.one_hot_names(levels, ["a", "a_b"]).collect()}
    assert names == {0: ("a", "b_c"), 1: ("a", "d"), 2: ("a_b", "c"), 3: ("a_b", "x")}
    unseen = spark.createDataFrame([(3, None, "new")], df.schema)
    assert encode.one_hot_positions(unseen, levels, ["a", "a_b"]).first()["positions"] == []


def test_plans_can_be_saved(spark, tmp_path):
    train = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "c string, v double")
    encode.FeaturePlan(["gone"], ["c"], encode.category_levels(train, ["c"])).save(str(tmp_path / "plan"))
    plan = encode.FeaturePlan.load(spark, str(tmp_path / "plan"))
    assert (plan.dropped, plan.coded) == (["gone"], ["c"])
    rows = spark.createDataFrame([("y",), ("z",), (None,)], "c string")
    assert [r["c"] for r in encode.encode_categories(rows, plan.levels, ["c"]).collect()] == [1, 2, 2]
    fitted = encode.fit_standardiser(train, ["v"])
    fitted.save(spark, str(tmp_path / "scores"))
    assert encode.Standardiser.load(spark, str(tmp_path / "scores")) == fitted


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_are_read_once_whatever_the_lookup(spark, monkeypatch, tmp_path, how):
    from foldwright.operators import joins

    keys = [1] * 2000 + [None] * 30 + list(range(2, 60)) + [99]
    spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    lookup = rows.where("k is null or k < 99").groupBy("k").agg(F.max("i").alias("most"), F.count(F.lit(1)).alias("n"))
    expected = joins.attach_by_group(rows, lookup, ["k"], "n", how)
    monkeypatch.setattr(joins, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(joins, "HOT_SHARE", 10)
    found = joins.attach_by_group(rows, lookup, ["k"], "n", how)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [k#") == 1
    assert found.columns == expected.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    assert found.count() == len(keys) - (how == "inner")
