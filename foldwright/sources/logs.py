"""Run logs and importance logs, as tables and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.functions.text import tolerant_double

# Fixed value: the line that ends a record in a text run log.
RECORD_END = "-" * 80


def read_importance_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, feature, importance) of the lines `Feature <i>, <name> importance: <number>`.

    Lines that are not two parts, or carry no number, are left out. The position
    orders lines inside a file: Spark reads them in file order.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        F.split(F.trim("value"), ", ").alias("_parts"),
    )
    second = F.split(F.get("_parts", F.lit(1)), ": ")
    parsed = lines.where(F.size("_parts") == 2).select(
        "file",
        F.struct("_block", "_line").alias("position"),
        F.get(F.split(F.get(second, F.lit(0)), " "), F.lit(0)).alias("feature"),
        tolerant_double(F.get(second, F.lit(1))).alias("importance"),
    )
    return parsed.where("importance is not null")


def important_features(log: DataFrame, below: float = -0.001) -> DataFrame:
    """(feature, importance) under the threshold, most negative first; the last line of a feature counts."""
    kept = log.where(F.col("importance") < below)
    last = kept.groupBy("feature").agg(F.max_by("importance", F.struct("file", "position")).alias("importance"))
    return last.orderBy("importance", "feature")


def important_feature_list(log: DataFrame, below: float = -0.001) -> DataFrame:
    """(feature, importance) of every line under the threshold in the order of the log, repeats included."""
    return log.where(F.col("importance") < below).orderBy("file", "position").select("feature", "importance")


def append_runs(runs: DataFrame, path: str, experiment: str = "experiment") -> None:
    """Add runs to a log table, one folder per experiment."""
    runs.write.mode("append").partitionBy(experiment).parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _settings_text(params: Column) -> Column:
    pairs = F.transform(
        F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return F.array_join(pairs, ", ")


def run_text(features: Column, params: Column, mean: Column, std: Column, test: Column, count: Column) -> Column:
    """One record of a text run log; `params` maps a model to its settings."""
    models = F.transform(
        F.array_sort(F.map_keys(params)),
        lambda m: F.concat(F.lit("Params "), m, F.lit(": "), _settings_text(F.element_at(params, m)), F.lit("\n")),
    )

    def score(value: Column) -> Column:
        return F.when(F.isnan(value), "nan").otherwise(F.format_string("%.4f", value))

    return F.concat(
        F.lit("Feature List: "), F.array_join(features, ", "), F.lit("\n"),
        F.array_join(models, ""),
        F.lit("Mean RMSE: "), score(mean), F.lit(", Std RMSE: "), score(std),
        F.lit(" ,Test RMSE: "), score(test), F.lit(", Features: "), count.cast("string"), F.lit("\n"),
    )


def write_run_text(records: DataFrame, path: str) -> None:
    """Append records (one string column) to a text run log."""
    records.write.mode("append").option("lineSep", RECORD_END + "\n").text(path)


def read_run_text(spark: SparkSession, path: str) -> DataFrame:
    """(features, params, mean_rmse, std_rmse, test_rmse, n_features), one row per record of a text run log."""
    text = spark.read.option("lineSep", RECORD_END + "\n").text(path).where("value rlike 'Mean RMSE: '")
    value = F.col("value")

    def number(label: str) -> Column:
        return tolerant_double(F.regexp_extract(value, label + r": ([-+.\w]+)", 1))

    named = F.regexp_extract_all(value, F.lit(r"(?m)^Params (\w+): .*$"), 1)
    settings = F.regexp_extract_all(value, F.lit(r"(?m)^Params \w+: (.*)$"), 1)
    return text.select(
        F.split(F.regexp_extract(value, r"(?m)^Feature List: (.*)$", 1), ", ").alias("features"),
        F.map_from_arrays(named, F.transform(settings, lambda s: F.str_to_map(s, F.lit(", "), F.lit(": ")))).alias(
            "params"
        ),
        number("Mean RMSE").alias("mean_rmse"),
        number("Std RMSE").alias("std_rmse"),
        number("Test RMSE").alias("test_rmse"),
        number("Features").cast("bigint").alias("n_features"),
    )
