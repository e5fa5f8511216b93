"""Approximate nearest neighbours from p-stable hash tables with multi-probe.

Each table cuts every vector's projections on random directions into cells of one width;
near vectors tend to share all cells. A query looks into its own bucket of each table and
into those next to it whose borders are nearest, up to `probes` buckets a table. Buckets
of more than `crowded` vectors are cut again by further projections, which the query probes
in the same way. Equal vectors count and are compared as one.

Buckets that lie near each other form units of bounded size, a task each. A vector goes to one unit
a table; a query goes to the units that its buckets lie in, mostly one or two a table, and finds its
buckets there, so that no row is shuffled once for every bucket. What is too large for one unit is cut
into several, down to parts of a bucket that a query sees all of. A first pass over one table gives
most queries a distance within which they have k neighbours; units return what is nearer, the k best
of each query as one row, and a last ranking joins the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldwright.functions.vectors import as_doubles
from foldwright.operators.neighbours import _hides, _mask_reach, best_of, nearest
from foldwright.operators.rings import matrix
from foldwright.session import scratch_space, stored

SAMPLE_ROWS = 2048
# Queries that the typical distance is taken from.
ASKED_ROWS = 256
# Most vectors that one unit holds, and queries that it is meant for.
PART_ROWS = 1 << 18
# Fewer vectors than this are not cut into units only to give all tasks work.
LEAST_ROWS = 4096
# Projections of a table that cut it into units.
AXES = 3
# Queries of a unit that look into their buckets at once, and pairs compared at once.
QUERY_ROWS = 1 << 14
PAIRS = 1 << 20
# Buckets with more pairs than this are compared as blocks.
DENSE_PAIRS = 1 << 13
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class HashTables:
    """Random directions, offsets and the cell width; the last `deeper` projections cut crowded buckets."""

    directions: np.ndarray  # (tables, dimension, projections)
    offsets: np.ndarray
    width: float
    deeper: int
    probes: int

    @staticmethod
    def fitted(
        sample: np.ndarray, k: int, rows: int, tables: int, projections: int, deeper: int, probes: int, reach: float, seed: int,
        typical: float | None = None,
    ) -> HashTables:
        """The width is `reach` times the typical distance to the k-th neighbour.

        Where that is not given, it is guessed for `rows` vectors like the sample: in the sample the
        neighbour of the same share of rows is looked at, but at least the first.
        """
        rng = np.random.default_rng(seed)
        if typical is None:
            asked = sample[: min(len(sample), ASKED_ROWS)]
            away = np.sort(np.sqrt(np.maximum(((asked[:, None] - sample[None]) ** 2).sum(-1), 0)), axis=1)
            place = min(max(1, round(k * len(sample) / max(rows, 1))), away.shape[1] - 1)
            typical = float(np.median(away[:, place])) if len(sample) > 1 else 1.0
        width = reach * typical if typical > 0 else 1.0
        size = sample.shape[1]
        directions = rng.standard_normal((tables, size, projections + deeper))
        return HashTables(directions, rng.uniform(0, width, (tables, projections + deeper)), width, deeper, probes)

    def cells(self, vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, where in its cell each projection lies, from 0 to 1)."""
        at = (vectors @ self.directions[table] + self.offsets[table]) / self.width
        whole = np.floor(at)
        return whole.astype(np.int64), at - whole

    def keys(self, cells: np.ndarray, table: int, deep: bool) -> np.ndarray:
        """Digests of rows of cells, one for each bucket."""
        cells = cells if deep else cells[..., : cells.shape[-1] - self.deeper]
        key = np.full(cells.shape[:-1], table * 2 + deep + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(cells.shape[-1]):
                key = (key ^ cells[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def near_cells(self, cells: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Cells that each query looks into: its own, then those over one or two nearest borders."""
        rows, count = cells.shape
        others = self.probes - 1
        gaps = np.concatenate([inside, 1 - inside], axis=1) ** 2  # to the border below and above
        order = np.argsort(gaps, axis=1, kind="stable")
        gaps = np.take_along_axis(gaps, order, 1)
        # Moves over the nearest borders; a move that others surely come before is left out.
        moves = [(j, -1) for j in range(min(2 * count, others))]
        for i in range(2 * count):
            for j in range(i + 1, 2 * count):
                if j + sum(j - a for a in range(i + 1)) - i - 1 < others:
                    moves.append((i, j))
        first, second = np.array(moves, np.int64).reshape(-1, 2).T
        score = gaps[:, first] + np.where(second < 0, 0, gaps[:, second])
        score[(second >= 0) & (np.abs(order[:, first] - order[:, second]) == count)] = np.inf  # there and back
        allowed = min(others, 2 * count + count * (2 * count - 1) - count)
        pick = np.argsort(score, axis=1, kind="stable")[:, :allowed]
        near = np.repeat(cells[:, None, :], allowed + 1, axis=1)
        at, place = np.arange(rows)[:, None], np.arange(1, allowed + 1)[None]
        for border, some in ((first[pick], slice(None)), (second[pick], second[pick] >= 0)):
            move = np.take_along_axis(order, np.maximum(border, 0), 1)
            step = np.where(move < count, -1, 1)
            where = np.broadcast_to(at, move.shape)[some], np.broadcast_to(place, move.shape)[some], (move % count)[some]
            near[where] += step[some]
        return near

    def probed_cells(self, vectors: np.ndarray, table: int, deep: bool) -> np.ndarray:
        """Cells of the buckets each query looks into; of shallow ones the deeper projections are 0."""
        cells, inside = self.cells(vectors, table)
        if deep:
            return self.near_cells(cells, inside)
        near = self.near_cells(cells[:, : cells.shape[1] - self.deeper], inside[:, : inside.shape[1] - self.deeper])
        return np.concatenate([near, np.zeros((*near.shape[:2], self.deeper), np.int64)], axis=2)

    def probed(self, vectors: np.ndarray, table: int, deep: bool) -> np.ndarray:
        """Keys of the buckets each query looks into."""
        return self.keys(self.probed_cells(vectors, table, deep), table, deep)


def _mod(keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A part for each key, whatever the keys are."""
    with np.errstate(over="ignore"):
        mixed = (keys.view(np.uint64) * _GOLDEN) >> np.uint64(32)
    return (mixed % np.asarray(parts).astype(np.uint64)).astype(np.int64)


@dataclass
class Units:
    """Which units the buckets lie in.

    A table is cut along its first projections into boxes of whole cells. A box has `subs` times `chunks` units
    from `first` on: its shallow buckets are dealt over the subs, and queries over the chunks, each
    of which holds all vectors. Buckets too large for a unit have units of their own, in the same way:
    crowded shallow ones by deep bucket, others by vector, where a query looks into all parts.
    """

    tables: HashTables
    cuts: list[list[np.ndarray]]  # by table and axis: first cells of the slices after the first
    boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by table: first, subs, chunks
    hot: np.ndarray  # keys of large buckets
    large: tuple[np.ndarray, np.ndarray, np.ndarray]  # first, subs, chunks
    deal: np.ndarray  # whether by deep bucket
    starts: np.ndarray  # where the units of each box or large bucket begin,
    owner: np.ndarray  # and its table
    total: int

    def box(self, table: int, cells: np.ndarray) -> np.ndarray:
        at = np.zeros(cells.shape[:-1], np.int64)
        for axis, cuts in enumerate(self.cuts[table]):
            at = at * (len(cuts) + 1) + np.searchsorted(cuts, cells[..., axis], side="right")
        return at

    def find_hot(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the large buckets, whether there)."""
        if not len(self.hot):
            return np.zeros(keys.shape, np.int64), np.zeros(keys.shape, bool)
        at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
        return at, self.hot[at] == keys

    def of_vectors(self, vectors: np.ndarray, ids: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, units): where each vector goes."""
        cells, _ = self.tables.cells(vectors, table)
        shallow, box = self.tables.keys(cells, table, False), self.box(table, cells)
        first, subs, chunks = (x[box] for x in self.boxes[table])
        first = first + _mod(shallow, subs) * chunks
        at, hit = self.find_hot(shallow)
        if hit.any():
            deep = self.tables.keys(cells, table, True)
            deeper, also = self.find_hot(deep)
            by_deep = hit & self.deal[at]
            at = np.where(by_deep & also, deeper, at)
            a, b, c = (x[at] for x in self.large)
            part = np.where(by_deep & ~also, _mod(deep, b), _mod(ids, b))
            first, chunks = np.where(hit, a + part * c, first), np.where(hit, c, chunks)
        rows = np.repeat(np.arange(len(first)), chunks)
        return rows, first[rows] + np.arange(len(rows)) - np.searchsorted(rows, rows)

    def of_queries(self, vectors: np.ndarray, ids: np.ndarray, table: int, home: bool) -> tuple[np.ndarray, np.ndarray]:
        """(rows, units): where the buckets that each query looks into lie; with `home` only one unit of its own bucket."""
        own = self.tables.cells(vectors, table)[0][:, None]
        cells = [own if home else self.tables.probed_cells(vectors, table, deep) for deep in (False, True)]
        below = np.arange(sum(c.shape[1] for c in cells)) >= cells[0].shape[1]  # deep buckets
        cells = np.concatenate(cells, axis=1)
        shallow, box = self.tables.keys(cells, table, False), self.box(table, cells)
        first, subs, chunks = (x[box] for x in self.boxes[table])
        whose = np.broadcast_to(np.arange(len(cells))[:, None], shallow.shape)
        mine = np.broadcast_to(ids[:, None], shallow.shape)
        units = first + _mod(shallow, subs) * chunks + _mod(np.ascontiguousarray(mine), chunks)
        at, hit = self.find_hot(shallow)
        rows, units = [whose[~hit]], [units[~hit]]
        if hit.any():
            by_deep = self.deal[at]
            deep = self.tables.keys(cells, table, True)
            deeper, also = self.find_hot(deep)
            one = hit & by_deep & below & ~also
            a, b, c = (x[at[one]] for x in self.large)
            rows.append(whose[one])
            units.append(a + _mod(deep[one], b) * c + _mod(mine[one], c))
            for every, places in ((hit & ~by_deep & ~below, at), (hit & by_deep & below & also, deeper)):
                a, b, c = (x[places[every]] for x in self.large)
                own, asker = mine[every], whose[every]
                times = np.ones(len(a), np.int64) if home else b
                seen = np.repeat(np.arange(len(a)), times)
                part = _mod(own, b) if home else np.arange(len(seen)) - np.searchsorted(seen, seen)
                rows.append(asker[seen])
                units.append(a[seen] + part * c[seen] + _mod(own, c)[seen])
        both = np.unique(np.concatenate(rows) * self.total + np.concatenate(units))
        return np.divmod(both, self.total)

    def table_of(self, unit: int) -> int:
        return int(self.owner[np.searchsorted(self.starts, unit, side="right") - 1])


def _counts(rows: DataFrame, kind: str, function) -> dict:
    """Numbers of rows by what `function` gives for (ids, vectors) of a batch, a few keys in all or those asked for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, times = np.unique(function(_numbers(batch.column(0)), matrix(batch.column(1))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])

    counted = rows.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in counted.where(kind).collect()}


def _units(queries: DataFrame, support: DataFrame, tables: HashTables, sample: np.ndarray, rows: int, crowded: int) -> Units:
    """Units of at most about PART_ROWS vectors each, as the vectors and queries are counted by box."""
    spark, count = support.sparkSession, len(tables.directions)
    tasks = spark.sparkContext.defaultParallelism
    least = min(PART_ROWS, max(LEAST_ROWS, rows * count // (4 * tasks)))
    axes = min(AXES, tables.directions.shape[2] - tables.deeper)
    slices = int(np.ceil((rows / least) ** (1 / axes) - 1e-9)) if axes else 1
    cuts = []
    for table in range(count):
        cells = tables.cells(sample, table)[0]
        at = [len(cells) * i // slices for i in range(1, slices)]
        cuts.append([np.unique(np.sort(cells[:, axis])[at]) for axis in range(axes)])
    none = np.zeros(0, np.int64)
    units = Units(tables, cuts, [], none, (none, none, none), none.astype(bool), none, none, 0)
    sizes = [int(np.prod([len(c) + 1 for c in own])) for own in cuts]
    shift = np.cumsum([0, *sizes])

    def boxes(_, vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([shift[t] + units.box(t, tables.cells(vectors, t)[0]) for t in range(count)])

    held, asked = np.zeros((2, shift[-1]), np.int64)
    for into, frame in ((held, support.select("support_id", "vector")), (asked, queries.select("query_id", "vector"))):
        for key, n in _counts(frame, "true", boxes).items():
            into[key] = n
    # Large buckets: there are at most as many as units.
    found: dict[int, tuple[int, int, bool]] = {}
    if (held > PART_ROWS).any():

        def shallow(vectors: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
            cells = tables.cells(vectors, t)[0]
            cells = cells[held[shift[t] + units.box(t, cells)] > PART_ROWS]
            return tables.keys(cells, t, False), tables.keys(cells, t, True)

        every = lambda function: lambda _, vectors: np.concatenate([function(vectors, t) for t in range(count)])
        first = _counts(support.select("support_id", "vector"), f"n > {PART_ROWS}", every(lambda v, t: shallow(v, t)[0]))
        deal = np.array(sorted(k for k, n in first.items() if n > crowded), np.int64)
        more = {}
        if len(deal):

            def deep(vectors: np.ndarray, t: int) -> np.ndarray:
                above, keys = shallow(vectors, t)
                return keys[np.isin(above, deal)]

            more = _counts(support.select("support_id", "vector"), f"n > {PART_ROWS}", every(deep))
        by_table = _owners(support, tables, [*first, *more])
        found = {k: (n, by_table[k], k in first and n > crowded) for k, n in {**first, **more}.items()}
    part = lambda n: np.maximum(-(-n // PART_ROWS), 1)
    subs = part(held)
    chunks = part(-(-asked // subs))
    keys = np.array(sorted(found), np.int64)
    hot_subs = part(np.array([found[k][0] for k in keys.tolist()], np.int64))
    ratio = max(1, -(-int(asked.sum()) // max(int(held.sum()), 1)))  # as in the whole
    hot_chunks = np.full(len(keys), ratio, np.int64)
    ends = np.cumsum(np.concatenate([subs * chunks, hot_subs * hot_chunks]))
    starts = ends - np.concatenate([subs * chunks, hot_subs * hot_chunks])
    units.boxes = [tuple(x[shift[t] : shift[t + 1]] for x in (starts, subs, chunks)) for t in range(count)]
    units.hot, units.large = keys, (starts[shift[-1] :], hot_subs, hot_chunks)
    units.deal = np.array([found[k][2] for k in keys.tolist()], bool)
    units.starts, units.total = starts, int(ends[-1])
    units.owner = np.concatenate([np.repeat(np.arange(count), sizes), np.array([found[k][1] for k in keys.tolist()], np.int64)])
    return units


def _owners(support: DataFrame, tables: HashTables, keys: list[int]) -> dict[int, int]:
    """The table of each of a few bucket keys."""
    wanted = np.array(sorted(keys), np.int64)

    def owned(_, vectors: np.ndarray) -> np.ndarray:
        out = []
        for t in range(len(tables.directions)):
            cells = tables.cells(vectors, t)[0]
            for deep in (False, True):
                own = tables.keys(cells, t, deep)
                out.append(np.searchsorted(wanted, own[np.isin(own, wanted)]) * len(tables.directions) + t)
        return np.concatenate(out)

    pairs = _counts(support.select("support_id", "vector"), "true", owned)
    return {int(wanted[p // len(tables.directions)]): int(p % len(tables.directions)) for p in pairs}


def _different(support: DataFrame, k: int) -> DataFrame:
    """(support_id, vector, support_ids, carried): different vectors with their lowest id, the k lowest and what these carry."""
    carried = [c for c in support.columns if c not in ("support_id", "vector")]
    order = Window.partitionBy("vector").orderBy("support_id")
    lowest = support.withColumn("_copy", F.dense_rank().over(order)).where(F.col("_copy") <= k)
    rows = F.collect_list(F.struct("support_id", *carried)).alias("_rows")
    same = lowest.groupBy("vector").agg(F.min("support_id").alias("support_id"), rows)
    lists = [F.col("_rows")[c].alias("support_ids" if c == "support_id" else c) for c in ("support_id", *carried)]
    return same.select("support_id", "vector", *lists)


def _numbers(ids: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(ids.fill_null(0).to_numpy(zero_copy_only=False))


def _bytes(x: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    x = np.ascontiguousarray(x, float)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _floats(column: pa.Array, size: int) -> np.ndarray:
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], float, len(column) * size, int(start)).reshape(-1, size)


def _dealt(queries: DataFrame, support: DataFrame, units: Units, which: list[int], home: bool, carried: list[str]) -> DataFrame:
    """(unit, id, vector, bound, carried): vectors, which have no bound, and queries, by unit, the vectors first."""
    shared = support.sparkSession.sparkContext.broadcast(units)
    types = to_arrow_schema(support.select(*carried).schema).types
    names = ["unit", "id", "vector", "bound", *carried]
    kinds = "unit int, id bigint, vector binary, bound double" + "".join(f", `{c}` {support.schema[c].dataType.simpleString()}" for c in carried)

    def deal(asked: bool):
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors, ids = matrix(batch.column(1)), _numbers(batch.column(0))
                packed = _bytes(vectors)
                for table in which:
                    rows, own = units.of_queries(vectors, ids, table, home) if asked else units.of_vectors(vectors, ids, table)
                    take = pa.array(rows)
                    rest = [pa.nulls(len(rows), t) for t in types] if asked else [c.take(take) for c in batch.columns[2:]]
                    bound = batch.column(2).take(take) if asked else pa.nulls(len(rows), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0).take(take), packed.take(take), bound, *rest], names)

        return spread

    rows = support.select("support_id", "vector", *carried).mapInArrow(deal(False), kinds)
    rows = rows.unionByName(queries.select("query_id", "vector", "bound").mapInArrow(deal(True), kinds))
    return rows.repartition(min(units.total, 1 << 12), "unit").sortWithinPartitions("unit", F.col("bound").isNotNull())


class _Unit:
    """The vectors of one unit, by bucket; `lists` has the ids of the rows that a vector stands for, and what they carry."""

    def __init__(self, units: Units, table: int, ids: pa.Array, vectors: np.ndarray, lists: list, crowded: int):
        self.tables, self.table = units.tables, table
        cells, _ = self.tables.cells(vectors, table)
        shallow = self.tables.keys(cells, table, False)
        at, hit = units.find_hot(shallow)
        _, own, times = np.unique(shallow, return_inverse=True, return_counts=True)
        deep = np.where(hit, units.deal[at] if len(units.deal) else False, times[own] > crowded)
        bucket = np.where(deep, self.tables.keys(cells, table, True), shallow)
        order = np.lexsort((_numbers(ids), bucket))
        take = pa.array(order)
        self.vectors = vectors[order]
        self.columns = [np.ascontiguousarray(c) for c in self.vectors.T]
        self.lists = [c.take(take) for c in lists]
        self.numbers = _numbers(ids)[order]
        self.buckets, self.starts, self.sizes = np.unique(bucket[order], return_index=True, return_counts=True)

    def looked(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets by query and probe, whether they are in this unit)."""
        keys = np.concatenate([self.tables.probed(vectors, self.table, deep) for deep in (False, True)], axis=1)
        at = np.minimum(np.searchsorted(self.buckets, keys), len(self.buckets) - 1)
        return at, self.buckets[at] == keys

    def pairs(self, rows: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of queries, rows of vectors) for each bucket looked into, by query, some at a time."""
        order = np.argsort(rows, kind="stable")
        rows, buckets = rows[order], buckets[order]
        ends = np.cumsum(self.sizes[buckets])
        start = 0
        while start < len(rows):
            # Whole queries, as many as make up PAIRS, or else one.
            done = ends[start - 1] if start else 0
            stop = np.searchsorted(ends, done + PAIRS, side="right")
            stop = np.searchsorted(rows, rows[stop]) if stop < len(rows) else stop
            if stop <= start:
                stop = np.searchsorted(rows, rows[start], side="right")
            sizes, some = self.sizes[buckets[start:stop]], self.starts[buckets[start:stop]]
            last = np.cumsum(sizes)
            yield np.repeat(rows[start:stop], sizes), np.arange(last[-1]) + np.repeat(some - last + sizes, sizes)
            start = int(stop)

    def squares(self, vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances of pairs."""
        total = np.zeros(len(a))
        for mine, other in zip(vectors.T, self.columns):
            gap = np.ascontiguousarray(mine)[a] - other[b]
            total += gap * gap
        return total

    def hidden(self, vectors: np.ndarray, a: np.ndarray, b: np.ndarray, squares: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Pairs that are nearly equal."""
        near = np.flatnonzero(squares <= (reach[a] * (1 + 1e-9)) ** 2)
        return near[_hides(vectors[a[near]], self.vectors[b[near]])]

    def limits(self, vectors: np.ndarray, k: int, reach: np.ndarray | None) -> np.ndarray:
        """Distance within which the buckets looked into hold k vectors with different ids."""
        out = np.full(len(vectors), np.inf)
        if not len(self.buckets):
            return out
        at, there = self.looked(vectors)
        rows, probe = np.nonzero(there)
        once = np.zeros(len(self.numbers), bool)
        once[np.unique(self.numbers, return_index=True)[1]] = True
        for a, b in self.pairs(rows, at[rows, probe]):
            squares = self.squares(vectors, a, b)
            squares[~once[b]] = np.inf
            if reach is not None:
                squares[self.hidden(vectors, a, b, squares, reach)] = np.inf
            asked, first, times = np.unique(a, return_index=True, return_counts=True)
            for low in (1 << i for i in range(32)):  # queries with alike numbers of pairs
                some = np.flatnonzero((times >= max(low, k)) & (times < 2 * low))
                if len(some):
                    wide = int(times[some].max())
                    place = first[some][:, None] + np.arange(wide)
                    table = np.where(np.arange(wide) < times[some][:, None], squares[np.minimum(place, len(squares) - 1)], np.inf)
                    out[asked[some]] = np.sqrt(np.partition(table, k - 1, axis=1)[:, k - 1])
        return out

    def best(self, vectors: np.ndarray, limits: np.ndarray, k: int, reach: np.ndarray | None, best) -> tuple:
        """(rows of queries, rows of vectors, distances, number compared): the k best of each query within its limit."""
        at, there = self.looked(vectors)
        rows, probe = np.nonzero(there)
        buckets = at[rows, probe]
        compared = int(self.sizes[buckets].sum())
        times = np.bincount(buckets, minlength=len(self.buckets))
        dense = (times * self.sizes >= DENSE_PAIRS) & (self.sizes > 2 * k)
        found = []
        block = dense[buckets]
        order = np.argsort(buckets[block], kind="stable")
        by, whose = buckets[block][order], rows[block][order]
        for bucket in np.unique(by):
            part = slice(self.starts[bucket], self.starts[bucket] + self.sizes[bucket])
            asked = whose[np.searchsorted(by, bucket) : np.searchsorted(by, bucket, side="right")]
            step = max(1, PAIRS // (part.stop - part.start))
            for q in (asked[i : i + step] for i in range(0, len(asked), step)):
                a, b, away = best(vectors[q], self.vectors[part], self.numbers[part], k, limits[q])
                found.append((q[a], part.start + b, away))
        for a, b in self.pairs(rows[~block], buckets[~block]):
            squares = self.squares(vectors, a, b)
            fit = np.flatnonzero(squares <= (limits[a] * (1 + 1e-9)) ** 2)
            a, b, squares = a[fit], b[fit], squares[fit]
            if reach is not None:
                keep = np.ones(len(a), bool)
                keep[self.hidden(vectors, a, b, squares, reach)] = False
                a, b, squares = a[keep], b[keep], squares[keep]
            found.append(_first(a, b, np.sqrt(squares), self.numbers, k))
        found.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
        a, b, away = (np.concatenate([f[i] for f in found]) for i in range(3))
        return *_first(a, b, away, self.numbers, k), compared

    def copies(self, a: np.ndarray, b: np.ndarray, away: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list]:
        """(rows of queries, distances, ids and what they carry) of the k best rows among those of found vectors."""
        starts = self.lists[0].offsets.to_numpy()
        sizes = np.diff(starts)[b]
        # Found vectors stand by distance: those after k rows, and not as near as the last of them, are left out.
        before = np.cumsum(sizes) - sizes
        before -= before[np.searchsorted(a, a)]
        last = np.full(a[-1] + 1 if len(a) else 0, np.inf)
        early = np.flatnonzero(before < k)
        last[a[early]] = away[early]
        kept = away <= last[a]
        a, b, away, sizes = a[kept], b[kept], away[kept], sizes[kept]
        pair = np.repeat(np.arange(len(b)), sizes)
        row = starts[b][pair] + np.arange(len(pair)) - np.searchsorted(pair, pair)
        values = [column.values for column in self.lists]
        a, row, away = _first(a[pair], row, away[pair], _numbers(values[0]), k)
        return a, away, [v.take(pa.array(row)) for v in values]


def _first(a: np.ndarray, b: np.ndarray, away: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The k best pairs of each query, by query and distance, ties by id."""
    order = np.lexsort((ids[b], away, a))
    a, b, away = a[order], b[order], away[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[kept], b[kept], away[kept]


def _visited(units: Units, size: int, crowded: int, answer):
    """Goes through rows by unit; `answer` gets the unit, its number and queries of it (ids, vectors, bounds)."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units.value
        number, unit, held, waiting, rows = None, None, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal unit, waiting, rows
            if not waiting:
                return
            if unit is None:
                table = pa.Table.from_batches(held).combine_chunks() if held else None
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns] if table else []
                ids = columns[1] if held else pa.array([], pa.int64())
                vectors = _floats(columns[2], size) if held else np.zeros((0, size))
                unit = _Unit(known, known.table_of(number), ids, vectors, columns[4:], crowded)
                held.clear()
            asked = pa.Table.from_batches(waiting).combine_chunks()
            column = lambda i: asked.column(i).combine_chunks()
            waiting, rows = [], 0
            yield from answer(unit, number, column(1), _floats(column(2), size), column(3).to_numpy(zero_copy_only=False))

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for start, stop in zip(edges, edges[1:]):
                part = batch.slice(start, stop - start)
                if own[start] != number:
                    yield from flush()
                    number, unit, rows = int(own[start]), None, 0
                    held.clear()
                vectors = part.column(3).null_count
                if vectors:
                    held.append(part.slice(0, vectors))
                if vectors < len(part):
                    waiting.append(part.slice(vectors))
                    rows += len(part) - vectors
                    if rows >= QUERY_ROWS:
                        yield from flush()
        yield from flush()

    return visit


def _typical(support: DataFrame, sample: np.ndarray, k: int, mask: bool) -> float | None:
    """Median distance of some of the sample to their k-th neighbour among all of `support`."""
    asked = sample[:ASKED_ROWS]
    wanted = k if mask else k + 1  # the vector itself comes first
    shared = support.sparkSession.sparkContext.broadcast(asked)
    near = best_of(mask)

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        kept = np.full((len(asked), wanted), np.inf)
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column(0))
                vectors = vectors[np.isfinite(vectors).all(1)]
                for part in (vectors[i : i + 4096] for i in range(0, len(vectors), 4096)):
                    rows, _, away = near(asked, part, np.arange(len(part)), wanted, kept[:, -1])
                    more = np.full((len(asked), wanted), np.inf)
                    more[rows, np.arange(len(rows)) - np.searchsorted(rows, rows)] = away
                    kept = np.sort(np.concatenate([kept, more], axis=1), axis=1)[:, :wanted]
        row, place = np.nonzero(np.isfinite(kept))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(kept[row, place])], ["asked", "away"])

    found = support.select("vector").mapInArrow(closest, "asked bigint, away double")
    order = Window.partitionBy("asked").orderBy("away")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    away = [r[0] for r in found.groupBy("asked").agg(F.max("away").alias("away")).select("away").collect()]
    return float(np.median(away)) if away else None


def _tables_for(
    support: DataFrame, k: int, mask: bool, tables: int, projections: int, deeper: int, probes: int, reach: float, seed: int
) -> tuple[HashTables, np.ndarray, int] | None:
    """(tables, sample, rows of support)."""
    sample = support.select("vector").orderBy(F.xxhash64("support_id"), "support_id").limit(SAMPLE_ROWS).collect()
    if not sample:
        return None
    sample = np.array([r[0] for r in sample], float)
    rows, typical = support.count(), _typical(support, sample, k, mask)
    return HashTables.fitted(sample, k, rows, tables, projections, deeper, probes, reach, seed, typical), sample, rows


def approximate_nearest(
    queries: DataFrame, support: DataFrame, k: int, mask: bool = True, tables: int = 4, projections: int = 4,
    deeper: int = 3, probes: int = 6, reach: float = 3.0, crowded: int = 1024, seed: int = 17,
) -> DataFrame:
    """(query_id, support_id, distance, ..., rank, pairs): like `neighbours.nearest`, but only hashed candidates are seen.

    Distances are exact; a neighbour is missed where no table puts it into a probed bucket. A
    query with fewer candidates than k gets those. `pairs` is the number of candidates compared in
    all, the same in every row; equal vectors are compared once, for the k lowest of their ids. The cell width is
    fitted on the distances of a bounded sample to the k-th of all different vectors; every vector is indexed.
    """
    with scratch_space(queries.sparkSession):
        queries = queries.select(F.col("query_id").cast("bigint").alias("query_id"), as_doubles(F.col("vector")).alias("vector"))
        queries = queries.where(F.col("query_id").isNotNull())
        support = support.withColumn("vector", as_doubles(F.col("vector"))).withColumn("support_id", F.col("support_id").cast("bigint"))
        carried = [c for c in support.columns if c not in ("support_id", "vector")]
        kinds = "query_id bigint, support_id bigint, distance double" + "".join(f", `{c}` {support.schema[c].dataType.simpleString()}" for c in carried)
        support = stored(_different(support, k), "different")
        fitted = _tables_for(support, k, mask, tables, projections, deeper, probes, reach, seed)
        if fitted is None:
            empty = queries.sparkSession.createDataFrame([], f"{kinds}, rank int, pairs bigint")
            return empty
        found, sample, count = fitted
        size = sample.shape[1]
        units = _units(queries, support, found, sample, count, crowded)
        shared = queries.sparkSession.sparkContext.broadcast(units)
        best, reach_of = best_of(mask), _mask_reach if mask else lambda vectors: None

        def bound_of(unit: _Unit, _: int, ids: pa.Array, vectors: np.ndarray, __: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Distances within which the unit of a query's own bucket holds k neighbours."""
            bound = unit.limits(vectors, k, reach_of(vectors))
            offsets = pa.array(np.arange(len(ids) + 1) * size, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array(bound)], ["query_id", "vector", "bound"])

        def compare(unit: _Unit, number: int, ids: pa.Array, vectors: np.ndarray, limits: np.ndarray) -> Iterator[pa.RecordBatch]:
            """One row a query with what it found in the unit, and one without an id that counts the pairs compared."""
            if not len(unit.buckets):
                return
            *found, compared = unit.best(vectors, limits, k, reach_of(vectors), best)
            rows, away, values = unit.copies(*found, k)
            whose, times = np.unique(rows, return_counts=True)
            offsets = pa.array(np.cumsum([0, *times]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (values[0], pa.array(away), *values[1:])]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(whose)), pa.nulls(len(whose), pa.int64()), *lists], names)
            mark = [pa.array([[uuid.uuid4().int >> 65]]), pa.array([[0.0]])]
            mark += [pa.array([[None]], values.type) for values in lists[2:]]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([compared], pa.int64()), *mark], names)

        names = ["query_id", "compared", "support_id", "distance", *carried]
        lists = "query_id bigint, compared bigint, support_id array<bigint>, distance array<double>"
        lists += "".join(f", `{c}` {support.schema[c].dataType.simpleString()}" for c in carried)

        # The units of a query's own buckets give a bound first, beyond which the others return nothing.
        unlimited = queries.select("query_id", "vector", F.lit(float("inf")).alias("bound"))
        near = _dealt(unlimited, support, units, [0], True, [])
        visit = _visited(shared, size, crowded, bound_of)
        limited = stored(near.mapInArrow(visit, "query_id bigint, vector array<double>, bound double"), "limited")
        dealt = _dealt(limited, support, units, list(range(tables)), False, ["support_ids", *carried])
        rows = dealt.mapInArrow(_visited(shared, size, crowded, compare), lists)
        # Tables find the same neighbours: each counts once. One shuffle serves this and the ranking.
        each = F.explode(F.arrays_zip(*names[2:])).alias("_one")
        pairs = rows.repartition("query_id").select("query_id", "compared", each)
        pairs = pairs.select("query_id", "compared", *[F.col("_one")[c].alias(c) for c in names[2:]])
        once = pairs.dropDuplicates(["query_id", "support_id"])
        order = Window.partitionBy("query_id").orderBy("distance", "support_id")
        ranked = once.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) | F.col("query_id").isNull())
        ranked = stored(ranked, "nearest", keep=True)
        seen = ranked.where("query_id is null").agg(F.coalesce(F.sum("compared"), F.lit(0))).first()[0]
        return ranked.where("query_id is not null").drop("compared").withColumn("pairs", F.lit(seen).cast("bigint"))


def recall(queries: DataFrame, support: DataFrame, k: int, sample: int = 256, **settings) -> DataFrame:
    """(k, asked, recall, pair_share): what the hash tables find, against exact search for a sample of queries.

    All queries are searched by hash; recall is the share of the exact k nearest found for `sample` of
    them, picked by hash of the id; `pair_share` is the share of all queries times vectors compared.
    """
    with scratch_space(queries.sparkSession):
        found = approximate_nearest(queries, support, k, **settings)
        asked = stored(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "sample")
        exact = nearest(asked, support, k).select("query_id", "support_id")
        # Of what is found only the rows of the sample are brought to the exact ones.
        theirs = found.join(F.broadcast(asked.select("query_id")), "query_id", "left_semi").select("query_id", "support_id")
        hits = exact.join(theirs, ["query_id", "support_id"], "left_semi")
        share = found.agg(F.max("pairs")).first()[0] or 0
        whole = queries.count() * support.count()
        counts = exact.agg(F.count(F.lit(1)).alias("all")).crossJoin(hits.agg(F.count(F.lit(1)).alias("hits")))
        row = counts.select(
            F.lit(k).alias("k"), F.lit(asked.count()).alias("asked"), (F.col("hits") / F.col("all")).alias("recall"),
            F.lit(share / whole if whole else 0.0).alias("pair_share"),
        )
        return stored(row, "recall", keep=True)
