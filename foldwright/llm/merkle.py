"""Merkle manifest of a table: a digest for every row, and proofs that it belongs to the whole.

Rows are leaves of one tree a source; the sources' roots are the leaves of one more tree.
Every `FANOUT` consecutive nodes become their digest, level by level, until one is left.
Only every `STRIDE`-th level is stored. A proof needs the levels between as well: they are
regenerated subtree by subtree from the stored level below, the siblings on every path are
emitted, and the nodes are discarded again. Proofs go down from the root, so that each
subtree meets the path of its own root, which all its rows share.

No task sees more than one subtree, whatever share of the rows a source holds, and only
digests and keys are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.operators.rowindex import with_row_index
from foldwright.session import pinned, scratch_space, stored

FANOUT = 16
# Levels from one stored level to the next: a subtree holds FANOUT ** STRIDE nodes.
STRIDE = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODES = "tree string, at bigint, node string"
_PATH = "array<struct<place: int, siblings: string>>"
# `top` is the root of the tree that the path leaves first: a source's.
_PATHS = f"tree string, at bigint, node string, top string, path {_PATH}"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(values: list[Column]) -> Column:
    """sha256 in hex of all values one after the other: `-` for NULL, else byte count, `:` and value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def lower_cased(text: Column) -> Column:
    """A-Z lower-cased; NULL stays."""
    return F.translate(text, _UPPER, _LOWER)


def _levels(nodes: list[str], at: int) -> list[list[str]]:
    """All levels of subtree number `at` of a tree, from `nodes` to its root.

    A tree's only subtree ends with the tree, at one node; all others have STRIDE levels
    above their nodes, also where they hold few.
    """
    levels = [nodes]
    while len(levels) <= STRIDE and (at > 0 or len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([digest("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return levels


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("at")


def _subtree() -> Column:
    return F.floor(F.col("at") / FANOUT**STRIDE).cast("bigint").alias("subtree")


def _next_level(nodes: DataFrame) -> DataFrame:
    """Roots of all subtrees over a stored level, from (tree, at, node)."""

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        tree, at = key[0].as_py(), key[1].as_py()
        root = _levels(_sorted(table).column("node").to_pylist(), at)[-1]
        return pa.table({"tree": [tree], "at": [at], "node": root})

    return nodes.select("tree", "at", "node").groupBy("tree", _subtree()).applyInArrow(fold, _NODES)


def _siblings(levels: list[list[str]]) -> list[list[tuple[int, str]]]:
    """For every level below the root and every node there: (place in its run, the others of the run)."""
    out = []
    for nodes in levels[:-1]:
        found = []
        for start in range(0, len(nodes), FANOUT):
            run = nodes[start : start + FANOUT]
            found += [(i, "".join(run[:i] + run[i + 1 :])) for i in range(len(run))]
        out.append(found)
    return out


def _folded(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and the siblings on its path give."""
    width = len(leaf)
    for place, siblings in path:
        leaf = digest(siblings[: place * width] + leaf + siblings[place * width :])
    return leaf


def _path_of(place: int, siblings: list[list[tuple[int, str]]]) -> list[tuple[int, str]]:
    return [found[place // FANOUT**level] for level, found in enumerate(siblings)]


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Paths to the root of every node of a stored level, given those of the next stored level."""

    def extend(key: tuple, own: pa.Table, roots: pa.Table) -> pa.Table:
        own = _sorted(own)
        names = own.column("node").to_pylist()
        siblings = _siblings(_levels(names, key[1].as_py()))
        rest = [(p["place"], p["siblings"]) for p in roots.column("path")[0].as_py()]
        paths = [_path_of(i, siblings) + rest for i in range(len(names))]
        return pa.table(
            {
                "tree": own.column("tree"),
                "at": own.column("at"),
                "node": own.column("node"),
                "top": pa.array([roots.column("top")[0].as_py()] * len(names), pa.string()),
                "path": pa.array([[{"place": p, "siblings": s} for p, s in path] for path in paths], _PATH_TYPE),
            }
        )

    left = nodes.select("tree", "at", "node").groupBy("tree", _subtree())
    right = above.select("tree", F.col("at").alias("subtree"), "top", "path").groupBy("tree", "subtree")
    return left.cogroup(right).applyInArrow(extend, _PATHS)


_PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))


@dataclass
class Tree:
    """Stored levels of a forest: `levels[0]` are the leaves, the last one has one node a tree."""

    levels: list[DataFrame]

    @staticmethod
    def over(leaves: DataFrame) -> Tree:
        """`leaves` has tree, at (from 0 in each tree) and node, and is stored."""
        levels = [leaves]
        while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
            levels.append(stored(_next_level(levels[-1]), "nodes"))
        return Tree(levels)

    def paths(self, above: DataFrame, down_to: int) -> DataFrame:
        """Paths of all nodes of level `down_to`, given those of the trees' roots (tree, at, path)."""
        for nodes in reversed(self.levels[down_to:-1]):
            above = stored(_paths(nodes, above), "paths")
        return above


def _placed(rows: DataFrame) -> DataFrame:
    """`rows` sorted by tree, doc_id and leaf, each with its place `at` in its tree, from 0.

    The rows are range-partitioned and pinned. One row a partition tells which tree is open
    at its start and how many leaves that has had.
    """
    fixed = pinned(rows.repartitionByRange("tree", "doc_id", "node", "altered").sortWithinPartitions("tree", "doc_id", "node", "altered"))
    counts = fixed.groupBy(F.spark_partition_id().alias("part"), "tree").count()
    ends = counts.groupBy("part").agg(F.min("tree").alias("first"), F.max("tree").alias("last"), F.max_by("count", "tree").alias("n"))
    open_at: dict[int, tuple[str, int]] = {}
    tree, count = "", 0
    for row in ends.orderBy("part").collect():
        open_at[row["part"]] = (tree, count)
        carried = count if row["first"] == row["last"] == tree else 0
        tree, count = row["last"], carried + row["n"]
    carry = rows.sparkSession.sparkContext.broadcast(open_at)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = carry.value.get(TaskContext.get().partitionId(), ("", 0))
        for batch in batches:
            places = []
            for own in batch.column("tree").to_pylist():
                tree, at = own, (at if own == tree else 0)
                places.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "at"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in fixed.dtypes)
    return fixed.mapInArrow(number, f"{kinds}, at bigint")


@dataclass
class Manifest:
    """A table's trees; `root` is the digest of everything, None for an empty table."""

    rows: Tree
    sources: Tree | None
    root: str | None

    def proofs(self, with_paths: bool = False) -> DataFrame:
        """One row a leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

        `proof_sha256` is the digest of all siblings from the leaf up. `folded_root` comes
        from the altered leaf where there is one, and the original siblings. With
        `with_paths` the siblings themselves come too, as `path`, and the leaf's `source`.
        """
        leaves, root = self.rows.levels[0], self.root
        kinds = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        if with_paths:
            kinds += f", source string, path {_PATH}"
        if self.sources is None:
            return leaves.sparkSession.createDataFrame([], kinds)
        top = self.sources.levels[-1].select("*", F.lit("").alias("top"), F.array().cast(_PATH).alias("path"))
        tops = self.sources.paths(top, 0)
        # From here on a tree is a source's; its root carries its path to the whole's root.
        names = self.sources.levels[0].select("at", F.col("name").alias("tree"))
        above = tops.select("at", F.col("node").alias("top"), "path").join(names, "at")
        above = above.withColumn("at", F.lit(0).cast("bigint"))
        if len(self.rows.levels) > 1:
            above = self.rows.paths(above, 1)

        def prove(key: tuple, own: pa.Table, roots: pa.Table) -> pa.Table:
            own = _sorted(own)
            leaves, altered = own.column("node").to_pylist(), own.column("altered").to_pylist()
            levels = _levels(leaves, key[1].as_py())
            siblings = _siblings(levels)
            rest = [(p["place"], p["siblings"]) for p in roots.column("path")[0].as_py()]
            upper = "".join(s for _, s in rest)
            proofs, folded, paths = [], [], []
            for i, leaf in enumerate(leaves):
                path = _path_of(i, siblings)
                proofs.append(digest("".join(s for _, s in path) + upper))
                folded.append(_folded(altered[i] or leaf, path + rest))
                if with_paths:
                    paths.append([{"place": p, "siblings": s} for p, s in path + rest])
            columns = {
                "tree": own.column("tree"),
                "doc_id": own.column("doc_id"),
                "leaf": own.column("node"),
                "subroot": pa.array([roots.column("top")[0].as_py()] * len(leaves), pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
            }
            return pa.table(columns | ({"path": pa.array(paths, _PATH_TYPE)} if with_paths else {}))

        kind = "tree string, doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string"
        kind += f", path {_PATH}" if with_paths else ""
        left = leaves.groupBy("tree", _subtree())
        right = above.select("tree", F.col("at").alias("subtree"), "top", "path").groupBy("tree", "subtree")
        proved = left.cogroup(right).applyInArrow(prove, kind)
        source = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("source")
        return proved.select(
            "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
            (F.col("folded_root") == root).alias("verified"), *([source, "path"] if with_paths else []),
        )


def build_manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: Column | None = None
) -> Manifest:
    """The trees over `docs`, one a source, leaves in the order of doc_id.

    `altered` is the digest that a row's leaf has after tampering, NULL where it is untouched; it
    is held against the original tree by `Manifest.proofs`.

    Defined cases: NULL sources are one tree, before all others, and differ from the empty
    source; rows without doc_id come first in their tree, rows that share one follow in the
    order of their digests, so repeated rows are leaves each; NULL and empty fields differ;
    whole texts count; columns other than doc_id, source and `fields` are not looked at. An empty table
    has no root and gives no proofs.
    """
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source")))
    other = F.lit(None).cast("string") if altered is None else altered
    rows = docs.select(
        tree.alias("tree"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        row_digest([F.col(f) for f in fields]).alias("node"),
        other.alias("altered"),
    )
    # Sorting samples its input first: texts are read for the digests alone, once.
    leaves = stored(_placed(stored(rows, "digests")), "leaves")
    forest = Tree.over(leaves)
    subroots = with_row_index(forest.levels[-1].select(F.col("tree").alias("name"), "node"), ["name"], "at")
    named = subroots.select(F.lit("").alias("tree"), (F.col("at") - 1).alias("at"), "node", "name")
    top = Tree.over(stored(named, "subroots"))
    last = top.levels[-1].first()
    return Manifest(forest, top if last else None, last["node"] if last else None)


def tampered(doc_id: Column) -> Column:
    """Whether 5 divides the crc32 of the decimal doc_id; never without one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def proofs_after_tampering(docs: DataFrame) -> DataFrame:
    """Proofs of all `docs`, checked after the texts of `tampered` rows were lower-cased."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    changed = row_digest([*[F.col(f) for f in fields], lower_cased(F.col("text"))])
    with scratch_space(docs.sparkSession):
        manifest = build_manifest(docs, altered=F.when(tampered(F.col("doc_id")), changed))
        return stored(manifest.proofs(), "proofs", keep=True)
