"""Scoring and id checks over files that arrive in a folder."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.streaming.predictors import check


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """Parquet files of a folder, `files` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def score_stream(
    stream: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    key: str,
    value: str,
    out: str,
    checkpoint: str,
) -> None:
    """Score each micro-batch, check its ids, then write it under its batch number.

    A batch that is run again after a failure overwrites its own folder, so its
    rows are in the output once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        scored = scorer(batch).select(key, value).persist()
        try:
            check(batch, scored, key, value)
            scored.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            scored.unpersist()

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def arrival_disorder(spark: SparkSession, path: str, time: str) -> int:
    """Seconds of event time by which a file of the folder may lie behind one that the stream reads before it.

    The stream reads files by modification time; those of the same millisecond may come in any order.
    """
    written = F.col("_metadata.file_modification_time").alias("written")
    stamp = F.col(time).cast("timestamp").cast("double")
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), written, stamp.alias("stamp"))
    files = rows.groupBy("written", "file").agg(F.min("stamp").alias("low"), F.max("stamp").alias("high"))
    latest, disorder = -math.inf, 0.0
    timed = files.where("low is not null").orderBy("written").collect()  # one row a file
    for _, group in groupby(timed, key=lambda file: file["written"]):
        spans = [(file["low"], file["high"]) for file in group]
        if len(spans) > 1:
            latest = max(latest, *(high for _, high in spans))
        disorder = max(disorder, latest - min(low for low, _ in spans))
        latest = max([latest, *(high for _, high in spans)])
    return math.ceil(disorder)


def unique_stream(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First arrival of each id; ids are remembered for `delay` of event time, which bounds the state.

    Rows that come later than that are dropped, so `delay` must exceed the disorder of the files.
    """
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def write_stream(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what has arrived to a Parquet folder and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _covers(wide: tuple[int, int], other: tuple[int, int]) -> bool:
    return wide != other and wide[0] <= other[0] and other[1] <= wide[1]


class IdTable:
    """Ids that have arrived, on storage, in buckets by hash; nothing of it is kept in memory.

    Every batch adds a segment `first_last` of its new ids, under the numbers of the batches it
    covers. After `merge_every` batches the segments become one. A segment counts once its
    write has succeeded, and batch n looks only at segments of batches before n, so that a batch that
    is run again finds what it found the first time and overwrites its own segment.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, merge_every: int = 20):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets, self.merge_every = buckets, merge_every

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _written(self) -> list[tuple[int, int]]:
        """All segments whose write has succeeded."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        found = []
        for status in files.listStatus(folder) if files.exists(folder) else []:
            first, _, last = status.getPath().getName().partition("_")
            whole = context._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if last.isdigit() and files.exists(whole):
                found.append((int(first), int(last)))
        return found

    def segments(self, before: int) -> list[tuple[int, int]]:
        """Written segments of batches before a number; merged ones in place of those they cover."""
        found = [s for s in self._written() if s[1] < before]
        return sorted(s for s in found if not any(_covers(o, s) for o in found))

    def _drop_covered(self, number: int) -> None:
        """Delete what a merged segment covers that batch `number`, should it run again, would read instead."""
        found = self._written()
        context = self.spark.sparkContext
        for first, last in found:
            if any(o[1] < number and _covers(o, (first, last)) for o in found):
                path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{first}_{last}")
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def _read(self, segments: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
        kinds = T.StructType([schema[self.key], T.StructField("bucket", T.IntegerType())])
        frames = [self.spark.read.schema(kinds).parquet(f"{self.path}/{first}_{last}") for first, last in segments]
        return reduce(DataFrame.unionByName, frames, self.spark.createDataFrame([], kinds))

    def new_rows(self, batch: DataFrame, number: int) -> DataFrame:
        """One row for each id of the batch that no earlier batch had: the least of its rows; NULL is an id too."""
        others = [c for c in batch.columns if c != self.key]
        once = batch.groupBy(self.key).agg(F.min(F.struct(*others)).alias("_row")) if others else batch.distinct()
        once = once.withColumn("bucket", self._bucket())
        touched = [r[0] for r in once.select("bucket").distinct().collect()]  # at most `buckets` numbers
        known = self._read(self.segments(number), batch.schema).where(F.col("bucket").isin(touched))
        known = known.withColumnsRenamed({self.key: "_known", "bucket": "_bucket"})
        same = (F.col("bucket") == F.col("_bucket")) & F.col(self.key).eqNullSafe(F.col("_known"))
        left = once.join(known, same, "left_anti")
        return left.select(*[F.col("_row")[c].alias(c) if c != self.key else F.col(c) for c in batch.columns])

    def add(self, rows: DataFrame, number: int) -> None:
        """Write the ids of a batch's new rows, and merge where enough segments have come together."""
        ids = rows.select(self.key).withColumn("bucket", self._bucket())
        ids.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{number}_{number}")
        self._drop_covered(number)
        held = self.segments(number + 1)
        if len(held) > self.merge_every:
            merged = self._read(held, rows.schema).repartition("bucket")
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{held[0][0]}_{number}")


def write_unique(stream: DataFrame, table: IdTable, out: str, checkpoint: str) -> None:
    """Append the first arrival of each id to a Parquet folder, whatever the order and span of the files.

    Ids are added after the rows are written. A batch that fails in between is run again, sees the same earlier
    segments, and overwrites its own rows and ids.
    """

    def handle(batch: DataFrame, number: int) -> None:
        table.new_rows(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")
        table.add(table.spark.read.schema(batch.schema).parquet(f"{out}/batch={number}"), number)

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
