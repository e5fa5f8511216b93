"""Callback and micro-batch scoring over the events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.plans.inputs import table
from foldwright.plans.registry import query
from foldwright.session import scratch_path, stored
from foldwright.streaming import micro_batches, predictors


def half_value(batch: pd.DataFrame) -> pd.DataFrame:
    """A sample callback."""
    return pd.DataFrame({"event_id": batch["event_id"], "prediction": batch["value"] * 0.5 + batch["event_type"].str.len()})


@query("select event_id, round(value * 0.5::double + length(event_type), 6) as prediction from events")
def score_with_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    known = predictors.Predictors(half_value)
    scored = stored(predictors.score(events, known, "half_value", "event_id"))
    predictors.check(events, scored, "event_id", "prediction")
    return scored.withColumn("prediction", F.round("prediction", 6))


def _as_files(df: DataFrame, path: str) -> None:
    """Files of consecutive times, as many as Spark makes of that much data; tasks may close them in another order."""
    df.repartitionByRange("ts").write.parquet(path)


def sample_plus_value(batch: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
    """A sample callback that fills in the expected rows; it also counts them."""
    return sample.assign(prediction=batch["value"].to_numpy() + len(sample))


@query(
    """with p as (select event_id, value, row_number() over (order by md5(event_id::varchar || '|7'), event_id) - 1 as place,
        count(*) over () as n from events)
    select event_id, round(value + least(100, n - place // 100 * 100), 6) as prediction from p"""
)
def batch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole evaluation run: checks, shuffle, batches of 100, callback, reconciliation, submission."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    sample = events.select("event_id", F.lit(0.0).alias("prediction"))
    out = scratch_path(spark, "submission")
    known = predictors.Predictors(sample_plus_value)
    status = predictors.evaluate(events, sample, known, "sample_plus_value", out, 7).first()
    if not status["Succeeded"]:
        raise RuntimeError(status["ErrorDetails"])
    return spark.read.parquet(out).withColumn("prediction", F.round("prediction", 6))


@query(
    """with p as (select event_id, value, row_number() over (order by md5(event_id::varchar || '|7'), event_id) - 1 as place,
        count(*) over () as n from events)
    select event_id, round(value + least(300, n - place // 300 * 300), 6) as prediction from p"""
)
def batch_evaluation_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in batches of 300."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    sample = events.select("event_id", F.lit(0.0).alias("prediction"))
    out = scratch_path(spark, "submission")
    known = predictors.Predictors(sample_plus_value)
    status = predictors.evaluate(events, sample, known, "sample_plus_value", out, 7, 300).first()
    if not status["Succeeded"]:
        raise RuntimeError(status["ErrorDetails"])
    return spark.read.parquet(out).withColumn("prediction", F.round("prediction", 6))


def forgetful(batch: pd.DataFrame) -> pd.DataFrame:
    """A sample callback that leaves an id out."""
    return half_value(batch).iloc[1:]


def failing(batch: pd.DataFrame) -> pd.DataFrame:
    """A sample callback that fails."""
    raise KeyError("no such column")


@query(
    """select * from (values ('half_value', true, null::varchar), ('forgetful', false, 'INVALID_SUBMISSION'),
        ('failing', false, 'SERVER_RAISED_EXCEPTION'), ('absent', false, 'SERVER_MISSING_ENDPOINT')) v(predictor, succeeded, failure)
    where exists (select 1 from events)"""
)
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evaluation runs over all events end, by predictor."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    sample = events.select("event_id", F.lit(0.0).alias("prediction"))
    known = predictors.Predictors(half_value, forgetful, failing)
    rows = []
    for name in ("half_value", "forgetful", "failing", "absent"):
        status = predictors.evaluate(events, sample, known, name, scratch_path(spark, "submission"), 7).first()
        rows.append((name, status["Succeeded"], status["ErrorName"]))
    return spark.createDataFrame(rows, "predictor string, succeeded boolean, failure string")


@query("select event_id, round(value * 2 + user_id, 6) as prediction from events")
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    root = scratch_path(spark, "stream")
    _as_files(events, f"{root}/in")
    stream = micro_batches.read_stream(spark, f"{root}/in", events.schema)

    def scorer(batch: DataFrame) -> DataFrame:
        return batch.withColumn("prediction", F.col("value") * 2 + F.col("user_id"))

    micro_batches.score_stream(stream, scorer, "event_id", "prediction", f"{root}/out", f"{root}/state")
    scored = spark.read.parquet(f"{root}/out").select("event_id", "prediction")
    return scored.withColumn("prediction", F.round("prediction", 6))


@query("select event_id, event_type from events")
def stream_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which a third arrive twice; ids are remembered on storage, for ever."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    root = scratch_path(spark, "unique")
    _as_files(events.unionByName(events.where(F.col("event_id") % 3 == 0)), f"{root}/in")
    stream = micro_batches.read_stream(spark, f"{root}/in", events.schema, files=64)
    micro_batches.write_unique(stream, micro_batches.IdTable(spark, f"{root}/ids", "event_id"), f"{root}/out", f"{root}/state")
    return spark.read.schema(events.schema).parquet(f"{root}/out").select("event_id", "event_type")


@query("select event_id, event_type from events")
def stream_unique_ids_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the ids in the stream's state, for the measured disorder of the files and an hour more."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    root = scratch_path(spark, "unique")
    _as_files(events.unionByName(events.where(F.col("event_id") % 3 == 0)), f"{root}/in")
    stream = micro_batches.read_stream(spark, f"{root}/in", events.schema)
    disorder = micro_batches.arrival_disorder(spark, f"{root}/in", "ts")
    unique = micro_batches.unique_stream(stream, "event_id", "ts", f"{disorder + 3600} seconds")
    micro_batches.write_stream(unique, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("event_id", "event_type")
