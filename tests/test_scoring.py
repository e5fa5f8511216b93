import sys

import pandas as pd
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foldwright.streaming import micro_batches, predictors

# As a user would for callbacks of a module the executors do not have.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def doubled(batch):
    return pd.DataFrame({"prediction": batch["x"] * 2, "id": batch["id"]})


def as_arrow(batch):
    return pa.table({"id": batch["id"], "prediction": batch["x"].astype(int)})


def with_sample(batch, sample):
    assert len(sample) == len(batch) <= 4 and list(sample.columns) == ["id", "prediction"]
    return sample.assign(prediction=batch["x"].to_numpy() + len(sample))


def forgetful(batch):
    return doubled(batch)[lambda rows: rows["id"] != 3]


def broken(batch):
    raise KeyError("no such column")


def as_list(batch):
    return [1, 2, 3]


@pytest.fixture
def rows(spark):
    return spark.range(10).select("id", (F.col("id") / 2).alias("x"))


def test_registry_takes_named_functions():
    known = predictors.Predictors(doubled)
    assert known.named("doubled") is doubled
    with pytest.raises(ValueError):
        known.add(lambda batch: batch)
    with pytest.raises(TypeError):
        known.add("doubled")
    with pytest.raises(predictors.ScoringFailure):
        known.named("other")


def test_outputs_are_unified(spark, rows):
    known = predictors.Predictors(doubled, as_arrow)
    assert {r["id"]: r["prediction"] for r in predictors.score(rows, known, "doubled", "id").collect()} == {
        i: float(i) for i in range(10)
    }
    assert predictors.score(rows, known, "as_arrow", "id").schema == predictors.score(rows, known, "doubled", "id").schema
    assert predictors.score(rows, known, "as_arrow", "id").count() == 10


def test_sample_and_batch_size(spark, rows):
    known = predictors.Predictors(with_sample)
    found = predictors.score(rows.coalesce(1), known, "with_sample", "id", size=4).collect()
    assert {r["id"]: r["prediction"] for r in found} == {i: i / 2 + (4 if i < 8 else 2) for i in range(10)}


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("doubled", None),
        ("forgetful", "INVALID_SUBMISSION"),
        ("broken", "SERVER_RAISED_EXCEPTION"),
        ("as_list", "SERVER_RAISED_EXCEPTION"),
        ("unknown", "SERVER_MISSING_ENDPOINT"),
    ],
)
def test_failures_are_reported_by_kind(spark, rows, name, kind):
    known = predictors.Predictors(doubled, forgetful, broken, as_list)

    def action():
        predictors.check(rows, predictors.score(rows, known, name, "id"), "id", "prediction")

    status = predictors.run_scoring(action, spark).first()
    assert status["Succeeded"] is (kind is None) and status["ErrorName"] == kind


def test_evaluation(spark, rows, tmp_path):
    known = predictors.Predictors(doubled, forgetful)
    sample = rows.select("id", F.lit(0.0).alias("prediction"))

    def run(frame, expected, name, out):
        return predictors.evaluate(frame, expected, known, name, str(tmp_path / out), 1, 4).first()["ErrorName"]

    assert run(rows, sample, "doubled", "a") is None
    assert spark.read.parquet(str(tmp_path / "a")).count() == 10
    assert run(rows, sample, "forgetful", "b") == "INVALID_SUBMISSION"
    assert run(rows, sample, "other", "b") == "SERVER_MISSING_ENDPOINT"
    assert run(rows.union(rows.limit(1)), sample, "doubled", "b") == "GATEWAY_RAISED_EXCEPTION"
    assert run(rows, sample.where("id < 9"), "doubled", "b") == "GATEWAY_RAISED_EXCEPTION"
    assert run(rows.select("x", "id"), sample, "doubled", "b") == "GATEWAY_RAISED_EXCEPTION"
    assert not (tmp_path / "b").exists()


def test_other_failures_are_the_runs_own(spark):
    status = predictors.run_scoring(lambda: 1 / 0, spark).first()
    assert status["ErrorName"] == "GATEWAY_RAISED_EXCEPTION"


def test_stream_equals_batch(spark, rows, tmp_path):
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = micro_batches.read_stream(spark, str(tmp_path / "in"), rows.schema)

    def scorer(batch):
        return batch.withColumn("p", F.col("x") + 1)

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    micro_batches.score_stream(stream, scorer, "id", "p", out, state)
    found = spark.read.parquet(out)
    assert {r["id"]: r["p"] for r in found.collect()} == {i: i / 2 + 1 for i in range(10)}
    assert found.select("batch").distinct().count() == 3
    # Nothing new has come: a second run adds nothing.
    micro_batches.score_stream(stream, scorer, "id", "p", out, state)
    assert spark.read.parquet(out).count() == 10


def test_stream_stops_at_a_bad_batch(spark, rows, tmp_path):
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = micro_batches.read_stream(spark, str(tmp_path / "in"), rows.schema)

    def loses_a_row(batch):
        return batch.where("id <> 4").withColumn("p", F.col("x"))

    with pytest.raises(Exception, match="missing: 1"):
        micro_batches.score_stream(stream, loses_a_row, "id", "p", str(tmp_path / "out"), str(tmp_path / "state"))
    assert not (tmp_path / "out").exists()


def test_batches_of_a_hundred(spark):
    placed = predictors.shuffled_batches(spark.range(230), "id", 1)
    assert sorted(r["count"] for r in placed.groupBy("batch_id").count().collect()) == [30, 100, 100]


def counts_rows(batch, sample):
    return sample.assign(prediction=float(len(batch)))


def other_batch(batch):
    """Answers for the ids of the batch before."""
    return pd.DataFrame({"id": (batch["id"] + 4) % 10, "prediction": 0.0})


@pytest.mark.parametrize(("size", "limit", "setting"), [
    (100, 250, "spark.sql.execution.arrow.maxRecordsPerBatch"),
    (300, 250, "spark.sql.execution.arrow.maxRecordsPerBatch"),
    (300, 1000, "spark.sql.execution.arrow.maxBytesPerBatch"),
])
def test_batches_do_not_follow_arrow(spark, tmp_path, size, limit, setting):
    before = spark.conf.get(setting)
    rows = spark.range(25_000).select("id", (F.col("id") / 2).alias("x"))
    sample = rows.select("id", F.lit(0.0).alias("prediction"))
    spark.conf.set(setting, limit)
    try:
        out = str(tmp_path / "out")
        status = predictors.evaluate(rows, sample, predictors.Predictors(counts_rows), "counts_rows", out, 1, size).first()
    finally:
        spark.conf.set(setting, before)
    assert status["Succeeded"]
    found = {r["prediction"]: r["count"] for r in spark.read.parquet(out).groupBy("prediction").count().collect()}
    rest = 25_000 % size
    assert found == {float(size): 25_000 - rest, **({float(rest): rest} if rest else {})}


def test_a_batch_must_bring_its_own_ids(spark, rows, tmp_path):
    sample = rows.select("id", F.lit(0.0).alias("prediction"))
    known = predictors.Predictors(other_batch)
    status = predictors.evaluate(rows, sample, known, "other_batch", str(tmp_path / "out"), 1, 4).first()
    assert status["ErrorName"] == "INVALID_SUBMISSION"


def written_backwards(df, path):
    """Five files of consecutive times; the last range is closed first."""
    bounds = df.selectExpr("percentile_approx(ts, array(0.2, 0.4, 0.6, 0.8)) as p").first()["p"]
    edges = [None, *bounds, None]
    for low, high in reversed(list(zip(edges, edges[1:]))):
        part = df.where(F.col("ts") >= low) if low else df
        part.where(F.col("ts") < high if high else F.lit(True)).coalesce(1).write.mode("append").parquet(path)


def test_unique_ids_of_files_out_of_order(spark, sf_dir, monkeypatch):
    from foldwright.plans import scoring

    monkeypatch.setattr(scoring, "_as_files", written_backwards)
    found = scoring.stream_unique_ids(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    assert sorted(found.collect()) == sorted(events.collect())


def test_arrival_disorder(spark, tmp_path):
    path = str(tmp_path / "in")
    for n, (low, high) in enumerate([(100, 200), (201, 300), (50, 90), (301, 310)]):
        rows = spark.createDataFrame([(low,), (high,), (None,)], "s long").select(F.col("s").cast("timestamp").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(path)
        assert micro_batches.arrival_disorder(spark, path, "ts") == (250 if n >= 2 else 0)
