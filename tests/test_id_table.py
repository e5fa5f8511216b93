import random

from pyspark.sql import functions as F

from foldwright.streaming.micro_batches import IdTable, read_stream, write_unique

KINDS = "id bigint, at bigint, kind string"


def test_ids_once_in_any_order(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.choice([None, *range(300)]), draw.randrange(10**9), draw.choice("abc")) for _ in range(2000)]
    for i in range(9):  # files in no order of time, over years
        spark.createDataFrame(rows[i::9], KINDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], KINDS).schema)
    table = IdTable(spark, f"{tmp_path}/ids", "id", buckets=4, merge_every=3)
    write_unique(stream, table, f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch").collect()
    assert sorted(r["id"] is None for r in got).count(True) == 1
    assert len(got) == len({r["id"] for r in got}) == len({r[0] for r in rows})
    assert {tuple(r) for r in got} <= set(rows)
    assert len(table.segments(9)) < 9 and table.segments(9)[0][0] == 0


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    table = IdTable(spark, f"{tmp_path}/ids", "id", buckets=3, merge_every=2)
    batches = [spark.createDataFrame([(i % 40, i, "x") for i in range(n * 25, n * 25 + 30)], KINDS) for n in range(6)]
    first = []
    for number, batch in enumerate(batches):
        rows = table.new_rows(batch, number)
        first.append(sorted(rows.collect()))
        table.add(rows, number)
    assert sum(len(f) for f in first) == 40
    assert sorted(table.new_rows(batches[5], 5).collect()) == first[5]  # the last batch, run again
    assert len(table._written()) < 6
    assert table.new_rows(batches[0], 6).collect() == []


def test_an_unfinished_segment_does_not_count(spark, tmp_path):
    table = IdTable(spark, f"{tmp_path}/ids", "id", buckets=2)
    batch = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], KINDS)
    assert table.segments(5) == []
    table.add(table.new_rows(batch, 0), 0)
    assert table.segments(0) == [] and table.segments(1) == [(0, 0)]
    (tmp_path / "ids" / "0_0" / "_SUCCESS").unlink()
    assert table.segments(1) == [] and table.new_rows(batch, 1).count() == 2


def test_only_touched_buckets_are_read(spark, tmp_path):
    table = IdTable(spark, f"{tmp_path}/ids", "id", buckets=16)
    table.add(spark.range(1000).select("id"), 0)
    one = spark.createDataFrame([(7,)], "id bigint")
    bucket = one.select(F.pmod(F.xxhash64("id"), F.lit(16))).first()[0]
    plan = table.new_rows(one, 1)._jdf.queryExecution().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan and str(bucket) in plan
