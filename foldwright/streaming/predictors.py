"""Named prediction callbacks over batches of rows."""

from __future__ import annotations

import inspect
import types
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foldwright.operators.joins import reconcile
from foldwright.operators.rowindex import with_batch, with_seeded_position
from foldwright.session import stored
from foldwright.sources.sinks import FAILURES, MAX_DETAILS, STATUS_SCHEMA, write_table


class ScoringFailure(Exception):
    """A failure of a scoring run, by kind."""

    def __init__(self, kind: str, details: str = ""):
        super().__init__(f"{kind}: {details}")
        self.kind, self.details = kind, details


class Predictors:
    """Callbacks known by their function names."""

    def __init__(self, *functions: Callable):
        self._known: dict[str, Callable] = {}
        for function in functions:
            self.add(function)

    def add(self, function: Callable) -> Callable:
        if not isinstance(function, types.FunctionType):
            raise TypeError(f"a predictor is a function, not {type(function).__name__}")
        if function.__name__ == "<lambda>":
            raise ValueError("a predictor needs a name; a lambda has none")
        self._known[function.__name__] = function
        return function

    def named(self, name: str) -> Callable:
        if name not in self._known:
            raise ScoringFailure("SERVER_MISSING_ENDPOINT", f"no predictor is registered as {name}")
        return self._known[name]


def _as_table(result, schema: pa.Schema) -> pa.Table:
    """Predictions as the declared columns, whatever table a callback returned."""
    if isinstance(result, pd.DataFrame):
        result = pa.Table.from_pandas(result, preserve_index=False)
    elif isinstance(result, dict):
        result = pa.table(result)
    elif isinstance(result, pa.RecordBatch):
        result = pa.Table.from_batches([result])
    if not isinstance(result, pa.Table):
        raise ScoringFailure("INVALID_SUBMISSION", f"unsupported predictions type {type(result).__name__}")
    return result.select(schema.names).cast(schema)


def _whole_batches(parts: Iterator[pa.RecordBatch], size: int | None, batch: str | None) -> Iterator[pa.Table]:
    """The batches a callback is to see, whatever the size of Arrow's.

    With `batch`, the rows that follow one another with one value of that column; with `size`,
    as many rows, less at the end of a partition; otherwise Arrow's own.
    """
    held: list[pa.RecordBatch] = []
    for part in parts:
        start = 0
        if batch is not None:
            numbers = part.column(batch).to_pylist()
            for i, number in enumerate(numbers):
                last = numbers[i - 1] if i else held[-1].column(batch)[-1].as_py() if held else number
                if number != last:
                    held.append(part.slice(start, i - start))
                    yield pa.Table.from_batches(held)
                    held, start = [], i
        elif size is not None:
            missing = size - sum(h.num_rows for h in held)
            while part.num_rows - start >= missing:
                held.append(part.slice(start, missing))
                yield pa.Table.from_batches(held)
                held, start, missing = [], start + missing, size
        if part.num_rows > start:
            held.append(part.slice(start))
        if held and batch is None and size is None:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def predict(
    df: DataFrame, predictor: Callable, schema: T.StructType, size: int | None = None, batch: str | None = None
) -> DataFrame:
    """Run a callback over batches of rows and cast its output to `schema`.

    The callback gets a pandas frame, and a second one with the expected ids and
    empty predictions if it takes two. Batches are Arrow's, or `size` rows, or, with `batch`, the
    rows that hold one value of that column, which must follow one another in a partition. These are
    collected across Arrow's batches, and every one must come back with its own ids.
    """
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields])
    key, value = schema.names
    takes_sample = len(inspect.signature(predictor).parameters) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_batches(batches, size, batch):
            number = whole.column(batch)[0].as_py() if batch else None
            rows = (whole.drop_columns([batch]) if batch else whole).to_pandas()
            sample = [rows[[key]].assign(**{value: 0.0})] if takes_sample else []
            found = _as_table(predictor(rows, *sample), arrow)
            if batch is not None and sorted(found.column(key).to_pylist(), key=repr) != sorted(
                whole.column(key).to_pylist(), key=repr
            ):
                raise ScoringFailure("INVALID_SUBMISSION", f"{_OTHER_IDS} {number}")
            yield from found.to_batches()

    return df.mapInArrow(run, schema)


_OTHER_IDS = "other ids than those of batch"


def _arrow_type(kind: T.DataType) -> pa.DataType:
    # The column types a prediction may have.
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string()}
    return simple[kind.simpleString()]


def shuffled_batches(df: DataFrame, key: str, seed: int, size: int = 100) -> DataFrame:
    """Rows with their place in a seeded order and the number of their batch."""
    return with_batch(with_seeded_position(df, key, seed), "position", size)


def score(
    df: DataFrame,
    predictors: Predictors,
    name: str,
    key: str,
    value: str = "prediction",
    size: int | None = None,
    batch: str | None = None,
) -> DataFrame:
    """(key, value) from the named callback."""
    schema = T.StructType([df.schema[key], T.StructField(value, T.DoubleType())])
    return predict(df, predictors.named(name), schema, size, batch)


def check(expected: DataFrame, predicted: DataFrame, key: str, value: str) -> None:
    """Raise unless every id came back exactly once with a value."""
    issues = reconcile(expected, predicted, key, value).groupBy("issue").count().collect()
    if issues:
        found = ", ".join(sorted(f"{r['issue']}: {r['count']}" for r in issues))
        raise ScoringFailure("INVALID_SUBMISSION", found)


def run_scoring(action: Callable[[], object], spark) -> DataFrame:
    """Run a scoring action and describe how it went as one status row."""
    try:
        action()
        row = (True, None, None, None)
    except ScoringFailure as failure:
        row = (False, FAILURES[failure.kind], failure.kind, failure.details[:MAX_DETAILS] or None)
    except Exception as error:  # noqa: BLE001 - a status row reports every failure
        raised_in_callback = "PythonException" in type(error).__name__ or "PythonException" in str(error)
        kind = "SERVER_RAISED_EXCEPTION" if raised_in_callback else "GATEWAY_RAISED_EXCEPTION"
        if raised_in_callback and _OTHER_IDS in str(error):
            kind = "INVALID_SUBMISSION"
        row = (False, FAILURES[kind], kind, str(error)[:MAX_DETAILS] or None)
    return spark.createDataFrame([row], STATUS_SCHEMA)


def check_inputs(rows: DataFrame, sample: DataFrame, key: str) -> None:
    """Raise unless both start with the key, ids are unique, and both hold the same ids."""
    if rows.columns[0] != key or sample.columns[0] != key:
        raise ValueError(f"{key} must be the first column")
    found = reconcile(rows.select(key), sample, key, sample.columns[1]).groupBy("issue").count().collect()
    unique = rows.groupBy(key).count().where("count > 1").isEmpty()
    if found or not unique:
        raise ValueError(f"ids of rows and sample submission differ or repeat: {found}")


def evaluate(
    rows: DataFrame,
    sample: DataFrame,
    predictors: Predictors,
    name: str,
    out: str,
    seed: int,
    size: int = 100,
) -> DataFrame:
    """Score all rows in shuffled batches and write the submission to `out`; returns the status row.

    Each task takes whole batches of the shuffled order and calls the predictor once
    per batch, which must return the ids of that batch. Predictions are kept before they are checked
    as a whole, so a callback runs once.
    """
    key, value = sample.columns[:2]

    def action() -> None:
        predictors.named(name)
        check_inputs(rows, sample, key)
        batches = shuffled_batches(rows, key, seed, size)
        in_order = batches.repartitionByRange("batch_id").sortWithinPartitions("position")
        predicted = stored(score(in_order.drop("position"), predictors, name, key, value, batch="batch_id"))
        check(sample, predicted, key, value)
        write_table(predicted, out)

    return run_scoring(action, rows.sparkSession)


def union_batches(parts: list[DataFrame]) -> DataFrame:
    """Predictions of all batches in one frame, matched by column name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
