import numpy as np
import pandas as pd
import pytest

from foldwright.operators import hashing


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 20, (40, 6))
    points = centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.5, (6000, 6))
    points[:2000] = centres[0] + rng.normal(0, 0.5, (2000, 6))  # a third in one cluster
    frame = pd.DataFrame({"support_id": range(len(points)), "vector": list(points), "label": [i % 7 for i in range(len(points))]})
    return points, spark.createDataFrame(frame, "support_id bigint, vector array<double>, label double")


def test_recall_with_few_pairs(clustered):
    _, support = clustered
    queries = support.select(support.support_id.alias("query_id"), "vector")
    row = hashing.recall(queries, support, 10, crowded=64).first()
    assert (row["k"], row["asked"]) == (10, 256)
    assert row["recall"] >= 0.9 and row["pair_share"] < 0.1


def test_found_rows_are_true(clustered, monkeypatch):
    monkeypatch.setattr(hashing, "PART_ROWS", 300)  # buckets in parts, queries in chunks
    points, support = clustered
    queries = support.select(support.support_id.alias("query_id"), "vector")
    found = hashing.approximate_nearest(queries, support, 5, crowded=100_000).toPandas()
    assert found.groupby("query_id").size().max() <= 5 and found.query_id.nunique() == len(points)
    away = np.sqrt(((points[found.query_id] - points[found.support_id]) ** 2).sum(1))
    assert np.abs(away - found.distance).max() < 1e-12 and (found.label == found.support_id % 7).all()
    assert (found.query_id != found.support_id).all() and not found.duplicated(["query_id", "support_id"]).any()
    ordered = found.sort_values(["query_id", "rank"])
    assert (ordered["rank"] == ordered.groupby("query_id").cumcount() + 1).all()
    assert ordered.groupby("query_id").distance.apply(lambda d: d.is_monotonic_increasing).all()


def test_small_and_empty(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "support_id bigint, vector array<double>")
    queries = rows.withColumnRenamed("support_id", "query_id")
    assert hashing.approximate_nearest(queries, rows.limit(0), 3).collect() == []
    assert hashing.approximate_nearest(queries.limit(0), rows, 3).collect() == []
    found = hashing.approximate_nearest(queries, rows, 3, mask=False, probes=50, reach=50.0).collect()
    assert {(r["query_id"], r["support_id"]) for r in found if r["distance"] == 0} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}


def test_probes_start_at_home():
    rng = np.random.default_rng(0)
    points = rng.normal(0, 1, (50, 4))
    tables = hashing.HashTables.fitted(points, 3, 50, tables=2, projections=3, deeper=2, probes=7, reach=2.0, seed=1)
    for table in range(2):
        cells, _ = tables.cells(points, table)
        for deep in (False, True):
            probed = tables.probed(points, table, deep)
            assert (probed[:, 0] == tables.keys(cells, table, deep)).all()
            assert all(len(set(row)) == 7 for row in probed.tolist())


def test_own_buckets_bound_the_others(clustered, monkeypatch, tmp_path):
    """Only neighbours within the distance found in a query's own buckets leave the buckets next to it."""
    points, support = clustered
    support = support.where("support_id < 2000")
    queries = support.select(support.support_id.alias("query_id"), "vector")
    best_of, folder = hashing.best_of, str(tmp_path)

    def counting(mask):
        best = best_of(mask)

        def counted(q, s, ids, k, limits):
            import pathlib
            import uuid

            found = best(q, s, ids, k, limits)
            bound = limits[found[0]] < float("inf")
            pathlib.Path(folder, uuid.uuid4().hex).write_text(f"{int(bound.sum())} {int((found[2] > limits[found[0]] + 1e-3).sum())}")
            return found

        return counted

    monkeypatch.setattr(hashing, "best_of", counting)
    found = hashing.approximate_nearest(queries, support, 5, crowded=64).toPandas()
    monkeypatch.setattr(hashing, "best_of", best_of)
    counts = np.array([list(map(int, f.read_text().split())) for f in tmp_path.iterdir()])
    assert 0 < counts[:, 0].sum() < 2000 * 5 * 24 / 3 and counts[:, 1].sum() == 0
    assert (found.groupby("query_id").size() <= 5).all() and found.query_id.nunique() == 2000


@pytest.mark.parametrize("crowded", [64, 100_000])
def test_units_change_nothing(clustered, monkeypatch, crowded):
    """Buckets cut into units of any size give the same neighbours from the same pairs."""
    _, support = clustered
    queries = support.where("support_id % 5 = 0").select(support.support_id.alias("query_id"), "vector")
    found = []
    for rows in (1 << 18, 500):
        monkeypatch.setattr(hashing, "PART_ROWS", rows)
        columns = ["query_id", "rank", "support_id", "pairs"]
        found.append(hashing.approximate_nearest(queries, support, 5, crowded=crowded).select(columns).toPandas().sort_values(columns[:2]))
    assert found[0].values.tolist() == found[1].values.tolist() and len(found[0]) > 5000


def test_rows_are_not_stored_for_every_bucket(clustered, monkeypatch):
    """Vectors and queries are written once, however many buckets they are compared in."""
    _, support = clustered
    queries = support.select(support.support_id.alias("query_id"), "vector")
    rows, stored = [], hashing.stored

    def counting(*args, **kept):
        out = stored(*args, **kept)
        rows.append(out.count())
        return out

    monkeypatch.setattr(hashing, "stored", counting)
    hashing.approximate_nearest(queries, support, 5, crowded=64)
    assert 0 < sum(rows) <= 6000 * (5 + 2) + 200


def test_width_is_that_of_all_rows(spark, monkeypatch):
    """A small sample does not make cells wider, nor do copies make them narrower."""
    points = np.random.default_rng(9).uniform(0, 1, (5000, 3))
    frame = pd.DataFrame({"support_id": range(len(points)), "vector": list(points)})
    support = spark.createDataFrame(frame, "support_id bigint, vector array<double>")
    widths = []
    for rows, copies in ((2048, 1), (100, 1), (100, 6)):
        monkeypatch.setattr(hashing, "SAMPLE_ROWS", rows)
        many = support.selectExpr(f"explode(sequence(0, {copies - 1})) as i", "*").selectExpr("support_id + 10000 * i as support_id", "vector")
        queries = many.where("support_id % 50 = 0").withColumnRenamed("support_id", "query_id")
        widths.append([])
        fitted = hashing.HashTables.fitted

        def seen(*args):
            widths[-1].append(fitted(*args))
            return widths[-1][-1]

        monkeypatch.setattr(hashing.HashTables, "fitted", staticmethod(seen))
        assert hashing.approximate_nearest(queries, many, 5).count() > 0
        monkeypatch.setattr(hashing.HashTables, "fitted", staticmethod(fitted))
    wide, small, copied = (w[0].width for w in widths)
    assert 0.8 < small / wide < 1.25 and 0.8 < copied / wide < 1.25
