"""Tables, id lists and lookup metadata from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.functions.text import recode

# How a feature is computed, by its type number.
COMPUTATION_TYPES = {1: "Compiler", 2: "Simulation"}
# Integer columns of the feature metadata.
METADATA_INTEGERS = ("TypeId", "DataTypeId", "ComputationTypeId", "LeafNode", "ShowOnWebsite")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, free_text: bool = False
) -> DataFrame:
    """CSV with a header; without a schema one more pass infers it.

    `free_text` allows line breaks inside quotes. Such files cannot be split, so
    they should come in many pieces.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", free_text)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_ids(spark: SparkSession, path: str, name: str = "Id") -> DataFrame:
    """Whitespace-separated ids, with the folder partitions of `path` as columns.

    The reader breaks at blanks, so a list of any length on one line is split over
    tasks; line ends and tabs inside a piece are handled piece by piece.
    """
    pieces = spark.read.option("lineSep", " ").text(path)
    rest = [c for c in pieces.columns if c != "value"]
    words = pieces.select(*rest, F.explode(F.split(F.col("value"), r"\s+")).alias("_word"))
    return words.where("_word <> ''").select(F.col("_word").cast("bigint").alias(name), *rest)


def recode_metadata(df: DataFrame) -> DataFrame:
    """Feature metadata with integer columns and named computation types."""
    typed = df.withColumns({c: F.col(c).cast("int") for c in METADATA_INTEGERS if c in df.columns})
    return typed.withColumn("ComputationTypeId", recode(F.col("ComputationTypeId"), COMPUTATION_TYPES))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes and blanks in text survive."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_ids(df: DataFrame, key: str, path: str) -> None:
    """One blank-separated id list in as many pieces as there are tasks."""
    df.select(F.col(key).cast("string").alias("value")).write.mode("overwrite").option("lineSep", " ").text(path)
