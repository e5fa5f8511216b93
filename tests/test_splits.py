import random

import pytest
from pyspark.sql import functions as F

from foldwright.operators import joins, splits


def plain_balanced(sizes: dict, folds: int) -> dict:
    loads, out = [0] * folds, {}
    for group, n in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        fold = loads.index(min(loads))
        out[group] = fold
        loads[fold] += n
    return out


def plain_target(items: list, folds: int) -> dict:
    loads, out = [0] * folds, {}
    for size in sorted({n for _, n, _ in items}, reverse=True):
        own = sorted((total, group) for group, n, total in items if n == size)
        runs = [own[i : i + folds] for i in range(0, len(own), folds)]
        for i, run in enumerate(runs):
            for _, group in run[::-1] if i % 2 else run:
                fold = loads.index(min(loads))
                out[group] = fold
                loads[fold] += size
    return out


@pytest.mark.parametrize("seed", range(300))
def test_turns_follow_the_plain_rule(seed):
    rng = random.Random(seed)
    folds = rng.randint(1, 7)
    loads = [rng.randint(0, rng.choice([0, 3, 50, 500])) for _ in range(folds)]
    size, count = rng.randint(1, 12), rng.randint(1, 120)
    segments, after = splits._spread(list(loads), size, count)
    plain, state = [], list(loads)
    for _ in range(count):
        fold = state.index(min(state))
        plain.append(fold)
        state[fold] += size
    found = []
    for rank in range(count):
        start, cycle = [s for s in segments if s[0] <= rank][-1]
        found.append(cycle[(rank - start) % len(cycle)])
    assert found == plain and after == state and len(segments) <= folds


def rows_with_a_hot_group(spark, groups: int):
    sizes = {g: 1 + g % 4 for g in range(groups)}
    sizes[groups] = sum(sizes.values()) // 2
    rows = [(g, (g * 7919 + i * 104729) % 2001 - 1000) for g, n in sizes.items() for i in range(n)]
    return sizes, rows, spark.createDataFrame(rows, "g bigint, y bigint")


@pytest.mark.parametrize("folds", [1, 3, 5])
def test_balanced_folds(spark, folds):
    sizes, _, df = rows_with_a_hot_group(spark, 400)
    found = {r["g"]: r["fold"] for r in splits.balanced_group_folds(df, "g", folds).collect()}
    assert found == plain_balanced(sizes, folds)


def test_fewer_groups_than_folds(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "g bigint")
    assert {r["g"]: r["fold"] for r in splits.balanced_group_folds(df, "g", 5).collect()} == {1: 0, 2: 1}


def test_target_balanced_folds(spark):
    _, rows, df = rows_with_a_hot_group(spark, 300)
    items = {}
    for g, y in rows:
        n, total = items.get(g, (0, 0))
        items[g] = (n + 1, total + y)
    plain = plain_target([(g, n, t) for g, (n, t) in items.items()], 5)
    found = splits.target_balanced_folds(df, "g", "y", 5)
    assert {r["g"]: r["fold"] for r in found.collect()} == plain


@pytest.mark.parametrize("limit", [100_000, 0])
def test_attach_keeps_every_row(spark, monkeypatch, limit):
    monkeypatch.setattr(joins, "BROADCAST_GROUPS", limit)
    monkeypatch.setattr(joins, "HOT_SHARE", 10)
    sizes, rows, df = rows_with_a_hot_group(spark, 200)
    df = df.unionByName(spark.createDataFrame([(None, 1), (None, 2)], "g bigint, y bigint"))
    lookup = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))
    got = joins.attach_by_group(df, lookup, ["g"], "n")
    assert got.columns == ["g", "y", "total"]
    assert got.count() == len(rows) + 2
    per_group = {r["g"]: r["total"] for r in lookup.collect()}
    assert all(r["total"] == per_group[r["g"]] for r in got.collect())
    missing = joins.attach_by_group(df, lookup.where("g > 5"), ["g"], "n", how="left")
    assert missing.count() == len(rows) + 2
    assert missing.where("total is null").count() == sum(n for g, n in sizes.items() if g <= 5) + 2


def test_folds_cover_rows_and_do_not_leak(spark):
    _, rows, df = rows_with_a_hot_group(spark, 120)
    folded = splits.attach_folds(df, splits.balanced_group_folds(df, "g", 4), "g")
    assert folded.count() == len(rows)
    assert splits.leaking_groups(folded, "g", "fold").count() == 0
    random_rows = df.withColumn("fold", F.pmod(F.col("y"), F.lit(3)))
    assert splits.leaking_groups(random_rows, "g", "fold").count() > 0


def test_reconcile(spark):
    expected = spark.createDataFrame([(1,), (2,), (3,), (4,)], "Id bigint")

    def issues(rows):
        given = spark.createDataFrame(rows, "Id bigint, p double")
        return sorted(tuple(r) for r in joins.reconcile(expected, given, "Id", "p").collect())

    clean = [(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.4)]
    assert issues(clean) == []
    assert issues(list(reversed(clean))) == []
    assert issues(clean[1:]) == [(1, "missing")]
    assert issues([*clean, (9, 0.9)]) == [(9, "extra")]
    assert issues([*clean, (2, 0.2)]) == [(2, "duplicate")]
    assert issues([*clean[:3], (4, None)]) == [(4, "null_prediction")]
