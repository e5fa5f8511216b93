"""Top-k inner products in blocks: what exact and approximate search share.

Vectors are ordered by nearest pivot and distance to it and cut into blocks of bounded
size, queries likewise into batches. A block keeps the least and greatest distance of its
vectors to every pivot; with a batch's own distances this bounds the largest inner product
the two can have (|q|^2 + |x|^2 - d^2 = 2<q, x>, and d is at least any difference of
distances to a pivot). A batch first visits the block of highest bound, which gives each
query a k-th score to beat, and then every block that may hold a better one. What happens
inside a visit is the method's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import scratch_space, stored

BLOCK_ROWS = 2048
BATCH_ROWS = 64
# Batches that visit one copy of a block in one task.
BATCHES_A_VISIT = 256
# Block summaries that one row of the list of blocks holds.
PAGE_BLOCKS = 4096
SAMPLE_ROWS = 2048

_PACKED = "part bigint, rows int, ids binary, vectors binary, distances binary, low binary, high binary, most double"
_SCORES = "query_id bigint, vec_id bigint, score double"

# (queries, their squared norms, thresholds, block) -> (query row, block row, score) of what may rank
Visit = Callable[["Packed", np.ndarray, "Packed"], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Neither NULL nor empty, and all components finite; with `nonzero` not all of them 0."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)
    return ok & F.exists(vector, lambda x: x != 0) if nonzero else ok


@dataclass
class Packed:
    """Vectors of one block or batch."""

    ids: np.ndarray
    vectors: np.ndarray
    distances: np.ndarray

    @staticmethod
    def of(row: dict, pivots: int) -> Packed:
        n = row["rows"]
        read = lambda name, dtype, width: np.frombuffer(row[name], dtype).reshape(n, width)
        ids = np.frombuffer(row["ids"], "<i8")
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(n, -1)
        return Packed(ids, vectors, read("distances", "<f8", pivots))


def choose_pivots(vectors: DataFrame, count: int, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """`count` vectors that lie far apart, of a sample of `sample_rows` picked by hash of the id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    sample = np.array([r[0] for r in rows], float)
    chosen = [0]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def distances_to(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances by direct differences, which lose no digits to cancellation."""
    out = np.empty((len(vectors), len(pivots)))
    for i, pivot in enumerate(pivots):
        gap = vectors - pivot
        out[:, i] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def packed(vectors: DataFrame, pivots: np.ndarray, rows: int) -> DataFrame:
    """`_PACKED` parts of at most `rows` vectors that lie near one another, stored."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = distances_to(_matrix(batch.column(1)), pivots)
                cell = away.argmin(axis=1)
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "cell", "away"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 33, [], 0

        def part(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            vectors = _matrix(table.column(1).combine_chunks())
            away = distances_to(vectors, pivots)
            most = float(np.einsum("ij,ij->i", vectors, vectors).max())
            ids = np.asarray(table.column(0)).astype("<i8")
            values = [number, len(ids), ids.tobytes(), vectors.astype("<f8").tobytes(), away.astype("<f8").tobytes()]
            values += [away.min(axis=0).tobytes(), away.max(axis=0).tobytes(), most]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        names = [c.split()[0] for c in _PACKED.split(", ")]
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= rows:
                table = pa.Table.from_batches(held)
                yield part(table.slice(0, rows))
                number += 1
                rest = table.slice(rows)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield part(pa.Table.from_batches(held))

    ordered = vectors.select("vec_id", "vector").mapInArrow(placed, "vec_id bigint, vector array<double>, cell int, away double")
    ordered = ordered.repartitionByRange("cell", "away", "vec_id").sortWithinPartitions("cell", "away", "vec_id")
    # Range bounds are sampled, so the parts are written once and only read from then on.
    return stored(ordered.select("vec_id", "vector").mapInArrow(pack, _PACKED), "packed")


def _pages(blocks: DataFrame) -> tuple[DataFrame, int]:
    """The blocks' summaries, `PAGE_BLOCKS` a row, numbered; and how many rows."""
    count = max(1, -(-blocks.count() // PAGE_BLOCKS))
    page = F.pmod(F.xxhash64("part"), F.lit(count)).cast("int")
    summary = F.struct(F.col("part").alias("block"), F.col("low").alias("block_low"), F.col("high").alias("block_high"), F.col("most").alias("block_most"))
    pages = blocks.select(page.alias("page"), summary.alias("s")).groupBy("page").agg(F.collect_list("s").alias("blocks"))
    return stored(pages, "pages"), count


def search(
    vectors: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int, visit: Visit, tie_by_id: bool = True
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` largest scores of each query, ties to smaller vec_id.

    Both inputs have vec_id and vector, an array of doubles of one length; a query is not its own
    candidate. Scores must be inner products of the vectors given.
    """
    with scratch_space(vectors.sparkSession):
        spark = vectors.sparkSession
        if not len(pivots):
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        p = len(pivots)
        blocks, batches = packed(vectors, pivots, BLOCK_ROWS), packed(queries, pivots, BATCH_ROWS)
        pages, page_count = _pages(blocks)
        copies = max(1, -(-batches.count() // BATCHES_A_VISIT))

        def bounds(query: Packed, low: np.ndarray, high: np.ndarray, most: float) -> np.ndarray:
            gap = np.maximum(np.maximum(low - query.distances, query.distances - high), 0).max(axis=1)
            norms = np.einsum("ij,ij->i", query.vectors, query.vectors)
            bound = (norms + most - gap * gap) / 2
            return bound + 1e-9 * (norms + most + 1)  # rounding must not rule out what fits

        def route(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks a batch visits: the best one, or all that may beat its thresholds."""
            for batch in rows:
                part, block, best = [], [], []
                for row in batch.to_pylist():
                    query = Packed.of(row, p)
                    least = row["least"] and np.frombuffer(row["least"], "<f8")
                    found = []
                    for s in row["blocks"]:
                        bound = bounds(query, np.frombuffer(s["block_low"]), np.frombuffer(s["block_high"]), s["block_most"])
                        if least is None or len(least) == 0:
                            found.append((float(bound.sum()), s["block"]))
                        elif s["block"] != row["home"] and (bound >= least).any():
                            found.append((float(bound.sum()), s["block"]))
                    if least is None and found:
                        found = [max(found)]
                    for value, number in found:
                        part.append(row["part"])
                        block.append(number)
                        best.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(best, pa.float64())], ["part", "block", "bound"]
                )

        def evaluate(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
            out = []
            for row in held.to_pylist():
                block = Packed.of(row, p)
                for ask in asked.to_pylist():
                    query = Packed.of(ask, p)
                    least = np.frombuffer(ask["least"], "<f8") if ask["least"] else np.full(len(query.ids), -np.inf)
                    at, to, score = visit(query, least, block)
                    kept = query.ids[at] != block.ids[to]
                    out.append(_top(query.ids[at[kept]], block.ids[to[kept]], score[kept], k))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        def visited(visits: DataFrame, asked: DataFrame) -> DataFrame:
            """Scores of the visits (part, block)."""
            asks = visits.select("part", "block").join(asked, "part").withColumn("copy", F.pmod(F.col("part"), F.lit(copies)))
            spread = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("copy", F.col("copy").cast("bigint"))
            spread = spread.withColumnRenamed("part", "block")
            left, right = asks.groupBy("block", "copy"), spread.groupBy("block", "copy")
            return left.cogroup(right).applyInArrow(evaluate, _SCORES)

        def routed(asked: DataFrame) -> DataFrame:
            every = F.explode(F.sequence(F.lit(0), F.lit(page_count - 1)))
            rows = asked.withColumn("page", every).join(pages, "page")
            return rows.mapInArrow(route, "part bigint, block bigint, bound double")

        nothing = F.lit(None)
        first = batches.withColumn("least", nothing.cast("binary")).withColumn("home", nothing.cast("bigint"))
        homes = routed(first).groupBy("part").agg(F.max(F.struct("bound", "block")).alias("b")).select("part", "b.block")
        homes = stored(homes, "homes")
        near = stored(visited(homes, first), "scores")

        # The k-th score so far is what a block has to reach.
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = near.withColumn("n", F.row_number().over(rank)).where(F.col("n") == k).select("query_id", "score")
        kth = kth.withColumnRenamed("score", "least_score")
        members = batches.mapInArrow(_members, "part bigint, place int, query_id bigint")
        least = (
            members.join(kth, "query_id", "left")
            .groupBy("part")
            .agg(F.array_sort(F.collect_list(F.struct("place", "least_score"))).alias("l"))
            .select("part", F.transform("l", lambda s: F.coalesce(s["least_score"], F.lit(float("-inf")))).alias("l"))
        )
        least = least.mapInArrow(_as_binary, "part bigint, least binary")
        second = batches.join(least, "part").join(homes.withColumnRenamed("block", "home"), "part")
        second = stored(second, "asked")
        far = visited(stored(routed(second), "visits"), second.drop("home"))
        ranked = near.unionByName(far).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        return stored(ranked.select("query_id", "rank", "vec_id", "score"), "ranked", keep=True)


def _members(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        parts, places, ids = [], [], []
        for part, held in zip(batch.column("part").to_pylist(), batch.column("ids").to_pylist()):
            own = np.frombuffer(held, "<i8")
            parts += [part] * len(own)
            places += range(len(own))
            ids += own.tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int64()), pa.array(places, pa.int32()), pa.array(ids, pa.int64())], ["part", "place", "query_id"]
        )


def _as_binary(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        held = [np.array(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["part", "least"])


def _top(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    first = np.concatenate([[True], queries[1:] != queries[:-1]]) if len(queries) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    place = np.arange(len(queries)) - starts[np.cumsum(first) - 1] if len(queries) else np.zeros(0, int)
    kept = place < k
    return queries[kept], ids[kept], scores[kept]
