"""Fold files, submissions and status rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.sources.tables import read_ids

# Failure kinds and their numbers, and the longest error text kept.
FAILURES = {
    "UNSPECIFIED": 0,
    "SERVER_NEVER_STARTED": 1,
    "SERVER_CONNECTION_FAILED": 2,
    "SERVER_RAISED_EXCEPTION": 3,
    "SERVER_MISSING_ENDPOINT": 4,
    "GATEWAY_RAISED_EXCEPTION": 5,
    "INVALID_SUBMISSION": 6,
}
MAX_DETAILS = 8000

STATUS_SCHEMA = T.StructType(
    [
        T.StructField("Succeeded", T.BooleanType()),
        T.StructField("ErrorType", T.IntegerType()),
        T.StructField("ErrorName", T.StringType()),
        T.StructField("ErrorDetails", T.StringType()),
    ]
)


def write_fold_files(df: DataFrame, key: str, fold: str, path: str) -> None:
    """Space-separated ids, one folder per fold. Every task writes its own ids: no list is gathered."""
    ids = df.select(F.col(key).cast("string").alias("value"), fold)
    ids.write.mode("overwrite").partitionBy(fold).option("lineSep", " ").text(path)


def read_fold_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, fold) of written fold files."""
    return read_ids(spark, path, key)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a Parquet table: submissions and fold tables."""
    df.write.mode("overwrite").parquet(path)


def status_rows(df: DataFrame) -> DataFrame:
    """Status rows from (failure, details): a NULL failure is a success, details are cut to MAX_DETAILS."""
    codes = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    return df.select(
        F.col("failure").isNull().alias("Succeeded"),
        F.element_at(codes, F.col("failure")).alias("ErrorType"),
        F.col("failure").alias("ErrorName"),
        F.when(F.col("failure").isNotNull(), F.substring(F.nullif("details", F.lit("")), 1, MAX_DETAILS)).alias(
            "ErrorDetails"
        ),
    )


def write_status(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS_SCHEMA).json(path)
