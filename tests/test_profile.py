import math

from pyspark.sql import functions as F

from foldwright.operators import profile


def test_wide_frame(spark):
    columns = [F.col("id").alias("key")]
    for i in range(800):
        kinds = [F.lit(i), F.lit(None).cast("double"), F.col("id") % (i + 2), F.when(F.col("id") % 2 == 0, i)]
        columns.append(kinds[i % 4].alias(f"c{i}"))
    wide = spark.range(1000).select(*columns)
    assert profile.constant_columns(wide) == [f"c{i}" for i in range(800) if i % 4 < 2]
    assert [r["column"] for r in profile.id_like_columns(wide).collect()] == ["key"]
    low = {r["column"]: r["n_unique"] for r in profile.low_cardinality_columns(wide, 200).collect()}
    expected = {f"c{i}": min(1000, i + 2) if i % 4 == 2 else 1 + (i % 4 == 3) for i in range(800)}
    assert low == {c: n for c, n in expected.items() if n < 200}


def test_null_is_a_value(spark):
    df = spark.createDataFrame(
        [(1, None, 1.0, [1, None]), (2, None, None, [1]), (3, None, 1.0, [1, None])],
        "a int, b string, c double, d array<int>",
    )
    assert {r["column"]: r["n_unique"] for r in profile.n_unique(df).collect()} == {"a": 3, "b": 1, "c": 2, "d": 2}
    assert profile.constant_columns(df) == ["b"]
    assert profile.drop_constant(df).columns == ["a", "c", "d"]
    assert profile.binary_column_count(df).first()[0] == 2
    assert {r["column"]: r["nulls"] for r in profile.null_counts(df).collect()} == {"a": 0, "b": 3, "c": 1, "d": 0}


def test_arrays_of_text_are_told_apart(spark):
    df = spark.createDataFrame([(["a, b"],), (["a", "b"],), ([None],), (["null"],)], "v array<string>")
    assert profile.n_unique(df).first()["n_unique"] == 4


def test_duplicates_and_counts(spark):
    df = spark.createDataFrame([("x", None), ("x", None), ("y", 1), (None, 1)], "a string, b int")
    assert profile.duplicate_rows(df).first()[0] == 1
    assert [tuple(r) for r in profile.value_counts(df, "a").collect()] == [("x", 2), (None, 1), ("y", 1)]
    assert profile.distinct_count(df, "a").first()[0] == 3


def test_one_row_group_has_no_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    row = profile.within_group_max_std(df, "g").first()
    assert row["feature"] == "x" and math.isclose(row["max_std"], math.sqrt(2))
    alone = profile.within_group_max_std(df.where("g = 'a'"), "g").first()
    assert alone["max_std"] is None


def test_row_sums_take_null_as_zero(spark):
    df = spark.createDataFrame([(1, None, 9), (None, None, 9), (1, 2, 9)], "num_a int, num_b int, other int")
    assert [tuple(r) for r in profile.row_sum_histogram(df, "^num_", "total").collect()] == [(0, 1), (1, 1), (3, 1)]


def test_nan_is_one_value(spark):
    df = spark.createDataFrame(
        [(float("nan"), float("nan"), 0.0), (float("nan"), 1.0, -0.0), (float("nan"), float("nan"), None)],
        "all_nan double, two double, zero double",
    )
    for found in (profile.low_cardinality_columns(df), profile.n_unique(df)):
        assert {r["column"]: r["n_unique"] for r in found.collect()} == {"all_nan": 1, "two": 2, "zero": 2}
    assert profile.binary_column_count(df).first()["binary_columns"] == 2


def test_instants_of_a_repeated_hour_differ(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("select timestamp_seconds(s) as t, repeat('x', 500) as s from values (1729989000), (1729992600) as v(s)")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert {r["column"]: r["n_unique"] for r in profile.n_unique(df).collect()} == {"t": 2, "s": 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
