"""Classes of linked items from buckets of candidates, without emitting all pairs of a bucket.

Items that may be linked share a bucket. Only classes are wanted, so two items known to
be in one class need no comparison. The first round compares one centre of every bucket with
the other members, by a bound on their sketches that no link can fail, verifies the pairs that
pass it and joins classes along the links found. What
remains are buckets that hold several classes: their members are compared inside the
tasks that hold them, by a bound that no link can fail, and of the pairs that pass
only as many are emitted as join classes. Those are verified in turn; rounds go on until
nothing passes that was not refused before. Then every pair of a bucket is in one
class, or ruled out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.words import released, sliced
from foldwright.session import scratch_space, stored

# Members of a bucket that one task compares with as many others at most.
BLOCK_ROWS = 2048
# Links that a task joins at a time on its own.
_HELD_LINKS = 200_000


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least): all ends of the links a[i] - b[i] and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            return nodes, nodes[root]
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root != root[root]).any():
            root = root[root]


def _forests(edges: DataFrame, tasks: int) -> DataFrame:
    """(node, component) inside runs of at most about `_HELD_LINKS` edges (u, v), which `tasks` tasks read where they are."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            ends = (np.concatenate([x.column(n).to_numpy() for x in held]) for n in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _least_reachable(*ends)], ["node", "component"])

        for batch in released(batches):
            if held and sum(x.num_rows for x in held) + batch.num_rows > _HELD_LINKS:
                yield from sliced(joined())
                held = []
            held.append(batch)
        if held:
            yield from sliced(joined())

    return edges.coalesce(tasks).mapInArrow(join, "node bigint, component bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without links are left out.

    `links` has node columns a and b. Tasks first join what the edges they hold connect. Where that takes more
    than one run of `_HELD_LINKS` edges, large-star and small-star rounds follow over stored
    tables, until the edges no longer change; every minimum is pre-aggregated, so a node
    with very many links costs its group no more than others.
    """
    with scratch_space(links.sparkSession):
        edges = stored(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
        tasks = max(1, -(-edges.count() // _HELD_LINKS))
        forests = _forests(edges, tasks)
        if tasks == 1:
            return stored(forests, "labels", keep=True)
        edges = stored(forests.where("node <> component").toDF("u", "v").distinct(), "edges")
        before = None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = stored(large.where("u <> v").distinct(), "edges")
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(state) == before:
                break
            before = tuple(state)
        nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return stored(nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct()), "labels", keep=True)


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("node"))
    joined = members.join(labels, "node", "left")
    return joined.withColumn("component", F.coalesce("component", "node"))


def _distinct_buckets(members: DataFrame) -> DataFrame:
    """The members, with the number `n` in their bucket, of buckets that hold an index member and more than one class; of equal buckets one.

    Equal buckets are told by two 64-bit digests of their members and their number.
    """
    keys = members.groupBy("key").agg(
        F.min("component").alias("_low"),
        F.max("component").alias("_high"),
        F.max("is_index").alias("_indexed"),
        F.bit_xor(F.xxhash64("node", "is_index")).alias("_one"),
        F.bit_xor(F.xxhash64(F.lit("two"), "is_index", "node")).alias("_two"),
        F.count(F.lit(1)).alias("n"),
    )
    keys = keys.where("_low <> _high and _indexed").groupBy("_one", "_two", "n").agg(F.min("key").alias("key")).select("key", "n")
    return stored(members.join(keys, "key"), "members")


def _open_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one class."""
    keys = members.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    return stored(members.join(keys.where("_low <> _high").select("key"), "key", "left_semi"), "members")


def _crowded_pairs(
    live: DataFrame, failed: DataFrame | None, sketches: DataFrame, bound: Callable, budget: int
) -> DataFrame:
    """Distinct pairs (a, b), a < b, that pass `bound` and would join classes: in each bucket as many as join all
    that can be joined, and up to `budget` more for each member, as some will be refused.

    Buckets of more than `BLOCK_ROWS` members are cut into blocks, and each task compares two of them.
    """
    rows = live.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.withColumn("other", F.explode(others)).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "is_index"
    )
    rows = rows.join(sketches, "node")
    if failed is None:
        rows = rows.withColumn("failed", F.lit(None).cast("array<bigint>"))
    else:
        refused = failed.groupBy("a").agg(F.collect_list("b").alias("failed"))
        rows = rows.join(refused.withColumnRenamed("a", "node"), "node", "left")
    names = ["key", "i", "j", "block", "node", "component", "is_index", "size", "sketch", "failed"]
    rows = rows.select(names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            pairs = _joining_pairs(pa.Table.from_batches(parts).to_pydict(), bound, budget)
            columns = [pa.array([p[n] for p in pairs], pa.int64()) for n in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        for batch in released(batches):
            keys = list(zip(*(batch.column(n).to_pylist() for n in range(3))))
            start = 0
            for n, key in enumerate(keys):
                if last is not None and key != last:
                    if n > start:
                        held.append(batch.slice(start, n - start))
                    yield found(held)
                    held, start = [], n
                last = key
            if len(keys) > start:
                held.append(batch.slice(start))
        if held:
            yield found(held)

    return rows.mapInArrow(compare, "a bigint, b bigint").distinct()


def _joining_pairs(rows: dict, bound: Callable, budget: int) -> list[tuple[int, int]]:
    nodes, indexed = rows["node"], np.array(rows["is_index"], bool)
    blocks, sizes = np.array(rows["block"]), np.array(rows["size"], np.int64)
    within = rows["i"][0] == rows["j"][0]
    class_of = {c: c for c in rows["component"]}

    def top(c):
        while class_of[c] != c:
            class_of[c] = class_of[class_of[c]]
            c = class_of[c]
        return c

    classes = np.array(rows["component"], np.int64)
    sketches, pairs = rows["sketch"], []
    for n in range(len(nodes)):
        later = np.arange(n + 1, len(nodes))
        keep = (classes[later] != classes[n]) & (indexed[later] | indexed[n])
        if not within:
            keep &= blocks[later] != blocks[n]
        later = later[keep]
        if not len(later):
            continue
        refused, more = set(rows["failed"][n] or ()), budget
        for m in later[bound(sketches, sizes, n, later)]:
            one, two = top(rows["component"][n]), top(rows["component"][m])
            # Nodes come sorted, so the smaller is `a`.
            if nodes[m] not in refused and (one != two or more > 0):
                pairs.append((nodes[n], nodes[m]))
                more -= one == two
                class_of[one] = two
    return pairs


def _passing(pairs: DataFrame, sketches: DataFrame, bound: Callable) -> DataFrame:
    """The pairs (a, b) that pass `bound`, told from their sketches alone."""
    sides = [sketches.select(*[F.col(c).alias(n if c == "node" else f"{c}_{n}") for c in ("node", "size", "sketch")]) for n in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = np.array([1])
        for batch in released(batches):
            sizes = np.stack([batch.column(n).to_numpy() for n in (2, 3)], axis=1)
            lines = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ok = [bool(bound(list(two), sizes[i], 0, other)[0]) for i, two in enumerate(lines)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "a bigint, b bigint")


def link_classes(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    sketches: Callable[[DataFrame], DataFrame],
    bound: Callable,
    known: DataFrame | None = None,
    spare: int = 2,
) -> DataFrame:
    """(node, component) of all linked nodes.

    `members` has key, node and is_index; pairs of a bucket count when at least one of
    them is_index. `verify` gets distinct pairs (a, b) with a < b and returns those that are links;
    `sketches` gets (node) and returns (node, size, sketch), from which `bound(sketches,
    sizes, n, others)` tells which others may be linked to row n; it must not refuse a link.
    `known` are links (a, b) that need no check. `spare` is how many pairs beyond those that join classes a member
    may emit in the first comparison of a bucket: more for a bound that often passes what is then refused.
    """
    with scratch_space(members.sparkSession):
        links = None if known is None else stored(known.select("a", "b"), "links")
        labels = None if links is None else components(links)
        live = _labelled(members.select("key", "node", "is_index").distinct(), labels)
        live = _distinct_buckets(stored(live, "members"))  # read twice
        one_each = live.where("is_index").groupBy("key").agg(F.min(F.struct("node", "component")).alias("c"))
        centres = one_each.select("key", F.col("c.node").alias("_a"), F.col("c.component").alias("_class"))
        pairs = live.join(centres, "key").where(F.col("component") != F.col("_class"))
        pairs = stored(pairs.select(F.least("_a", "node").alias("a"), F.greatest("_a", "node").alias("b")).distinct(), "pairs")
        failed, budget, near = None, spare, pairs
        if not pairs.isEmpty():
            # Sketches are small: they rule out most pairs before any text moves.
            held = stored(sketches(live.select("node").distinct()), "sketches")
            near = stored(_passing(pairs, held, bound), "near")
        while not pairs.isEmpty():
            found = stored(verify(near).select("a", "b"), "links")
            refused = pairs.join(found, ["a", "b"], "left_anti")
            failed = refused if failed is None else failed.unionByName(refused)
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                labels = components(links)
                live = _open_buckets(stored(_labelled(live.drop("component"), labels), "members"))
            if live.isEmpty():
                break
            near = pairs = stored(_crowded_pairs(live, failed, held, bound, budget), "pairs")
            budget *= 16  # so that pairs which pass but are refused end soon
        if labels is None:
            return members.sparkSession.createDataFrame([], "node bigint, component bigint")
        return stored(labels, "classes", keep=True)