import json
import math
import pathlib

from pyspark.sql import functions as F

from foldwright.sources import logs, sinks, tables


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    rows = [(1, 'he said "no", twice\nand left', 1.5), (2, " blank ", None), (3, "a,b", 0.1)]
    df = spark.createDataFrame(rows, "Id bigint, EnglishRules string, x double")
    tables.write_csv(df, str(tmp_path / "csv"))
    typed = tables.read_csv(spark, str(tmp_path / "csv"), df.schema, free_text=True)
    assert sorted(tuple(r) for r in typed.collect()) == rows
    guessed = tables.read_csv(spark, str(tmp_path / "csv"), free_text=True)
    assert dict(guessed.dtypes)["x"] == "double" and guessed.count() == 3


def test_ids_on_one_line_or_many(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("  12 7\t9\n\n1234567890123   4\r\n5")
    found = tables.read_ids(spark, str(tmp_path / "ids.txt"))
    assert sorted(r["Id"] for r in found.collect()) == [4, 5, 7, 9, 12, 1234567890123]


def test_fold_files_are_blank_separated(spark, tmp_path):
    path = str(tmp_path / "folds")
    df = spark.range(20).select(F.col("id").alias("Id"), (F.col("id") % 3).cast("int").alias("fold"))
    sinks.write_fold_files(df, "Id", "fold", path)
    text = " ".join(p.read_text() for p in sorted(pathlib.Path(path).glob("fold=1/*.txt")))
    assert sorted(int(x) for x in text.split()) == list(range(1, 20, 3))
    back = sinks.read_fold_files(spark, path, "Id").collect()
    assert sorted((r["Id"], r["fold"]) for r in back) == [(i, i % 3) for i in range(20)]


def test_importance_log(spark, tmp_path):
    lines = [
        "Feature 0, Alpha importance: -0.002",
        "Permutation 0 permuted_rmse: 0.4 val_rmse: 0.3",
        "Feature 1, Beta importance: -0.0005",
        "Feature 2, Gamma importance: none",
        "Feature 3, Alpha, importance: -5",
        "Feature 4, Delta",
        "Feature 5, Alpha importance: -0.003",
        "Feature 6, Delta importance: -1e-2",
        "",
    ]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    found = logs.important_features(logs.read_importance_log(spark, str(tmp_path / "log.txt"))).collect()
    assert [tuple(r) for r in found] == [("Delta", -0.01), ("Alpha", -0.003)]


def test_run_text(spark, tmp_path):
    end = "-" * 80
    (tmp_path / "runs.txt").write_text(
        "Feature List: a, b\nParams lgb: depth: 8, objective: mse\nParams xgb: eta: 0.1\n"
        f"Mean RMSE: 0.4237, Std RMSE: 0.0116 ,Test RMSE: 0.4035, Features: 2\n{end}\n"
        f"Feature List: c\nMean RMSE: 0.3770, Std RMSE: 0.0142 ,Test RMSE: nan, Features: 1\n{end}\n"
    )
    first, second = logs.read_run_text(spark, str(tmp_path / "runs.txt")).orderBy("mean_rmse").collect()
    assert first["features"] == ["c"] and first["params"] == {} and math.isnan(first["test_rmse"])
    assert second["params"] == {"lgb": {"depth": "8", "objective": "mse"}, "xgb": {"eta": "0.1"}}
    assert (second["mean_rmse"], second["std_rmse"], second["test_rmse"], second["n_features"]) == (0.4237, 0.0116, 0.4035, 2)


def test_status(spark, tmp_path):
    df = spark.createDataFrame([(None, None), ("INVALID_SUBMISSION", "é" * 9000)], "failure string, details string")
    sinks.write_status(sinks.status_rows(df), str(tmp_path / "status"))
    good, bad = sinks.read_status(spark, str(tmp_path / "status")).orderBy("Succeeded", ascending=False).collect()
    assert tuple(good) == (True, None, None, None)
    assert (bad["ErrorType"], len(bad["ErrorDetails"])) == (6, 8000)
    written = [json.loads(x) for p in (tmp_path / "status").glob("*.json") for x in p.read_text().splitlines()]
    assert {"Succeeded": True} in written


def test_metadata(spark):
    df = spark.createDataFrame([(1, "1", "1"), (2, "0", "2"), (3, "1", None)], "Id int, LeafNode string, ComputationTypeId string")
    found = {r["Id"]: (r["LeafNode"], r["ComputationTypeId"]) for r in tables.recode_metadata(df).collect()}
    assert found == {1: (1, "Compiler"), 2: (0, "Simulation"), 3: (1, None)}
