"""Lines that repeat up to a few edits, across all documents, by a segment-partition join.

Two lines within `edits` edits agree, somewhere near the same place, in one of the
edits + 1 even segments of the shorter. Each distinct line of a length indexes its
segments; a line probes, for each length up to `edits` below its own, the substrings
that can match a segment given the difference in length. Lines that meet are verified
by banded bit-parallel edit distance; classes follow along the links, and of each class
the first line by (doc_id, line number) stays.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.linking import link_classes
from foldwright.llm.words import released, sliced, text_slices
from foldwright.session import scratch_space, stored

# Bits of the table of wanted places: 32 a place, between these powers of two (64 KB and 16 MB).
_LEAST_BITS, _MOST_BITS = 1 << 19, 1 << 27
_BLANK = " \t\n\v\f\r"
# Keys a task holds before it joins equal ones on its own.
_HELD = 1_000_000
# Pairs of lines up to which they are broadcast to find their texts.
_BROADCAST_PAIRS = 200_000
_ROWS = "key bigint, node bigint, is_index boolean, centre bigint, low bigint, doc_id bigint, line_no int"
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_SCHEMA = pa.schema(list(zip([c.split()[0] for c in _ROWS.split(", ")], _KINDS)))


def line_digest(line: str) -> tuple[int, int]:
    """The two halves of a 128-bit digest, as signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")))


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the edits + 1 even segments; the longer ones come last."""
    size, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        own = size + (i > edits - longer)
        out.append((at, own))
        at += own
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings that a line looks up.

    Segment i can only match from starts that leave at most i edits before it and
    edits - i behind it. Those that equal the line's own segments are left out.
    """
    out = []
    for indexed in range(max(edits + 1, length - edits), length + 1):
        gap = length - indexed
        for i, (start, size) in enumerate(segments(indexed, edits)):
            low = max(start - i, start + gap - (edits - i), 0)
            high = min(start + i, start + gap + (edits - i), length - size)
            out += [(indexed, i, at, size) for at in range(low, high + 1) if gap or at != start]
    return out


def within_edits(a: str, b: str, edits: int) -> bool:
    """Whether insertions, deletions and replacements of characters, at most `edits`, turn a into b.

    A band of 2 * edits + 1 rows follows the diagonal; one machine word holds its
    vertical differences, one step per character.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    # Equal ends cost nothing.
    least = min(len(a), len(b))
    head = 0
    step = 1 << max(least.bit_length() - 1, 0)
    while step:
        if head + step <= least and a[head : head + step] == b[head : head + step]:
            head += step
        else:
            step >>= 1
    a, b = a[head:], b[head:]
    least -= head
    tail, step = 0, 1 << max(least.bit_length() - 1, 0)
    while step:
        if tail + step <= least and a[len(a) - tail - step : len(a) - tail] == b[len(b) - tail - step : len(b) - tail]:
            tail += step
        else:
            step >>= 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    m, n = len(a), len(b)
    if min(m, n) <= edits:
        return max(m, n) <= edits or _plain_distance(a, b) <= edits
    width = 2 * edits + 1
    mask, bottom = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + 1 + edits)
    up, down = mask ^ ((1 << edits) - 1), 0  # vertical +1 and -1 in the band of the next column
    score, worst = edits, 2 * edits + n - m
    for j in range(1, n + 1):
        match = (places.get(b[j - 1], 0) >> j) & mask
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right, left = (down | ~(diagonal | up)) & mask, diagonal & up
        if j <= m - edits:
            score += not diagonal & bottom
            if score > worst:
                return False
        else:
            row = 1 << (m - j + edits)
            score += bool(right & row) - bool(left & row)
        shifted = diagonal >> 1
        up, down = (left | ~(shifted | right)) & mask, shifted & right
    return score <= edits


def _plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def _joined_here(keys: np.ndarray, nodes: np.ndarray, indexed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, node, is_index), and the least index node of the key in this task where
    that is another node; rows without one have centre = node."""
    order = np.lexsort((nodes, ~indexed, keys))
    keys, nodes, indexed = keys[order], nodes[order], indexed[order]
    kept = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
    keys, nodes, indexed = keys[kept], nodes[kept], indexed[kept]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    at = np.repeat(first, np.diff(np.append(first, len(keys))))
    return keys, nodes, indexed, np.where(indexed[at], nodes[at], nodes)


def line_table(docs: DataFrame, edits: int, min_chars: int, short_repeats: bool = False) -> DataFrame:
    """`_ROWS`: every line's place, and the index and probe keys of the lines a task sees first.

    With `short_repeats`, lines under `min_chars` that are not blank have places too, but no keys.

    Lines of one task that meet an indexed line in a key are joined to it here, so that a very
    frequent key is few rows a task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, whole, unpack, seen = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest, struct.unpack, set()
        plans: dict[int, list] = {}
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            keys, owners, indexed, centre = _joined_here(*(np.concatenate(x) for x in zip(*held)))
            none = [pa.nulls(len(keys), k) for k in _KINDS[4:]]
            columns = [pa.array(keys.view(np.int64)), pa.array(owners), pa.array(indexed), pa.array(centre, mask=centre == owners)]
            return pa.RecordBatch.from_arrays([*columns, *none], schema=_SCHEMA)

        for batch in released(batches):
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                nodes, lows, ids, numbers, keys, owners, indexed = [], [], [], [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for number, line in enumerate(text.split("\n") if text else ()):
                        length = len(line)
                        if length < min_chars and not (short_repeats and line.strip(_BLANK)):
                            continue
                        raw = line.encode("utf-8", "surrogatepass")
                        node, low = unpack("<qq", whole(raw))
                        nodes.append(node)
                        lows.append(low)
                        ids.append(key)
                        numbers.append(number)
                        if length < min_chars or node in seen:
                            continue
                        seen.add(node)
                        plan = plans.get(length)
                        if plan is None:
                            plan = [(at, at + size, length << 8 | i) for i, (at, size) in enumerate(segments(length, edits))]
                            plan += [(at, at + size, other << 8 | i) for other, i, at, size in probes(length, edits)]
                            if len(plans) < 20_000:
                                plans[length] = plan
                        if len(raw) == length:  # one byte a character
                            keys += [digest(raw[a:b], seed) for a, b, seed in plan]
                        else:
                            keys += [digest(line[a:b].encode("utf-8", "surrogatepass"), seed) for a, b, seed in plan]
                        owners.append((node, len(plan)))
                if len(seen) > 2_000_000:
                    seen.clear()
                if keys:
                    sizes = np.array([n for _, n in owners])
                    place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    owner = np.repeat(np.array([o for o, _ in owners], np.int64), sizes)
                    held.append((np.array(keys, np.uint64), owner, place <= edits))
                    count += len(keys)
                n = len(nodes)
                columns = [pa.nulls(n, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64())]
                columns += [pa.array(v, k) for v, k in zip((lows, ids, numbers), _KINDS[4:])]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
                if count > _HELD:
                    yield from sliced(flush())
                    held, count = [], 0
        if count:
            yield from sliced(flush())

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rows, _ROWS)


def _bit_table(places: DataFrame, bits: int) -> np.ndarray:
    """Bytes in which bit `place` modulo `bits` is set for every place; bit i is bit i % 8 of byte i // 8."""
    slot = F.col("place").bitwiseAND(F.lit(bits - 1).cast("bigint")) + 1  # Spark's bitmaps count from 1
    parts = places.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit"))
    table = np.zeros((bits >> 15, 4096), np.uint8)
    for part, held in parts.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
        table[part - 1] = np.frombuffer(bytes(held), np.uint8)
    return table.ravel()


def _texts_of(docs: DataFrame, firsts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of some distinct lines, read from where they stand first, stored.

    Each wanted place (document and line number) sets a bit of a table of bounded size. Tasks read the
    documents where they are and send on the lines whose bit is set; a join then keeps those that were
    meant. So no whole text is shuffled, and a full table only lets more lines pass.
    """
    wanted = firsts.join(nodes, "node").select("node", "low", "doc_id", "line_no")
    place = F.xxhash64("doc_id").bitwiseXOR(F.col("line_no").cast("bigint"))
    wanted = stored(wanted.withColumn("place", place), "wanted")
    bits = min(max(1 << (32 * wanted.count()).bit_length(), _LEAST_BITS), _MOST_BITS)
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(wanted, bits))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_bits = table.value
        for batch in released(batches):
            for start, size in text_slices(batch.column(2), rows=1024, size=1 << 20):
                part = batch.slice(start, size)
                texts = [x.split("\n") if x else [] for x in part.column(2).to_pylist()]
                counts = np.array([len(x) for x in texts])
                owner = np.repeat(np.arange(len(texts)), counts)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                slot = (np.asarray(part.column(1), np.int64)[owner] ^ number) & (bits - 1)
                hits = np.flatnonzero(set_bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                owner, number = owner[hits], number[hits]
                lines = [texts[i][n] for i, n in zip(owner.tolist(), number.tolist())]
                halves = np.array([line_digest(x) for x in lines], np.int64).reshape(-1, 2)
                ids = part.column(0).take(pa.array(owner, pa.int64()))
                columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), ids, pa.array(number.astype(np.int32)), pa.array(lines, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "low", "doc_id", "line_no", "line"])

    key = F.col("doc_id").cast("bigint")
    found = docs.select(key.alias("doc_id"), F.xxhash64(key), "text").mapInArrow(
        fetch, "node bigint, low bigint, doc_id bigint, line_no int, line string"
    )
    # Rows may share a doc_id: only the line that was meant counts, once.
    meant = found.join(wanted.drop("place"), ["node", "low", "doc_id", "line_no"], "left_semi")
    return stored(meant.dropDuplicates(["node", "low"]).select("node", "line"), "texts")


class _Lines:
    """The texts of the lines that may be linked, read once for all rounds of `link_classes`."""

    def __init__(self, docs: DataFrame, firsts: DataFrame, edits: int):
        self.docs, self.firsts, self.edits = docs, firsts, edits
        self.texts: DataFrame | None = None

    def sketches(self, nodes: DataFrame) -> DataFrame:
        """(node, size, sketch) of the lines; it is asked for all nodes before any pair is verified."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                lines = batch.column(1).to_pylist()
                columns = [batch.column(0), pa.array([len(x) for x in lines], pa.int64()), pa.array([counted(x) for x in lines], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "size", "sketch"])

        self.texts = _texts_of(self.docs, self.firsts, nodes)
        return self.texts.mapInArrow(rows, "node bigint, size bigint, sketch binary")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) within `edits` edits."""
        edits = self.edits

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in released(batches):
                lines = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
                yield batch.select([0, 1]).filter(pa.array([within_edits(a, b, edits) for a, b in lines], pa.bool_()))

        a, b = (self.texts.select(F.col("node").alias(n), F.col("line").alias(f"line_{n}")) for n in ("a", "b"))
        # Few pairs go to where the lines are instead of moving all lines.
        first = F.broadcast(pairs) if pairs.count() <= _BROADCAST_PAIRS else pairs
        both = a.join(first, "a").join(b, "b").select("a", "b", "line_a", "line_b")
        return both.mapInArrow(near, "a bigint, b bigint")


def counted(line: str) -> bytes:
    """How often characters of each of 64 groups of the alphabet occur, modulo 2**16."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    groups = (codes * np.uint64(2654435761) >> np.uint64(16)) & np.uint64(63)
    return np.bincount(groups.astype(np.int64), minlength=64).astype("<u2").tobytes()


class _NearCounts:
    """Bound for `link_classes`: an edit changes the length by one at most, and counts by two in all."""

    def __init__(self, edits: int):
        self.edits = edits
        self.held: tuple = (None, None)

    def __call__(self, sketches: list, sizes: np.ndarray, n: int, others: np.ndarray) -> np.ndarray:
        if self.held[0] is not sketches:
            self.held = (sketches, np.frombuffer(b"".join(sketches), "<u2").reshape(-1, 64))
        near = np.abs(sizes[others] - sizes[n]) <= self.edits
        out = np.zeros(len(others), bool)
        own = self.held[1][others[near]] - self.held[1][n]  # wraps around as the counts do
        out[near] = np.minimum(own, -own).sum(axis=1, dtype=np.int64) <= 2 * self.edits
        return out


def removed_lines(docs: DataFrame, edits: int = 2, min_chars: int = 20, short_repeats: bool = False) -> DataFrame:
    """(doc_id, removed): the lines of each document that repeat an earlier one, as structs
    (line_no, node, low) with the line's digest; documents that lose nothing are left out.
    """
    with scratch_space(docs.sparkSession):
        rows = stored(line_table(docs.where("doc_id is not null"), edits, min_chars, short_repeats), "lines")
        places = rows.where("key is null").select("node", "low", "doc_id", "line_no")
        distinct = stored(
            places.groupBy("node", "low").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")),
            "distinct",
        )
        keys = rows.where("key is not null").select("key", "node", "is_index", "centre")
        here = keys.where("centre is not null")
        bucket = Window.partitionBy("key")
        across = keys.where("centre is null").select(
            "key", "node", "is_index", F.min("node").over(bucket).alias("_low"), F.max("node").over(bucket).alias("_high"), F.max("is_index").over(bucket).alias("_indexed")
        )
        members = across.where("_low <> _high and _indexed").select("key", "node", "is_index")
        members = members.unionByName(here.select("key", "node", "is_index"))
        members = members.unionByName(here.select("key", F.col("centre").alias("node"), F.lit(True).alias("is_index")))
        members = members.groupBy("key", "node").agg(F.max("is_index").alias("is_index"))
        firsts = distinct.select("node", "low", "first.doc_id", "first.line_no")
        lines = _Lines(docs, firsts, edits)
        labels = link_classes(members, lines.verify, lines.sketches, _NearCounts(edits), spare=64)
        # A class is a component of links or else one distinct line, told by both halves of its digest.
        classes = distinct.join(labels, "node", "left").where("n > 1 or component is not null")
        classes = classes.select(
            "node",
            "low",
            "first",
            F.coalesce("component", "node").alias("class"),
            F.when(F.col("component").isNull(), F.col("low")).otherwise(0).alias("class_low"),
        )
        kept = classes.groupBy("class", "class_low").agg(F.min("first").alias("kept"))
        classes = classes.join(kept, ["class", "class_low"])
        repeats = places.join(classes.select("node", "low", "kept"), ["node", "low"])
        repeats = repeats.where(F.struct("doc_id", "line_no") != F.col("kept"))
        removed = F.sort_array(F.collect_list(F.struct("line_no", "node", "low"))).alias("removed")
        return stored(repeats.groupBy("doc_id").agg(removed), "removed", keep=True)


def dedup_lines(
    docs: DataFrame, edits: int = 2, min_chars: int = 20, drop_emptied: bool = False, short_repeats: bool = False
) -> DataFrame:
    """`docs` with repeated lines taken out of `text`, and n_lines, n_removed added.

    A line is what stands between newlines. Of all lines of at least `min_chars`
    characters that are within `edits` edits of one another, directly or along a chain,
    the first by (doc_id, line number) stays. Shorter lines stay where they are, or with
    `short_repeats` go when the very same line stands before; blank ones always stay. With
    `drop_emptied`, documents go that lose lines and keep no other than white space. A column
    n_chars is brought up to date.

    Defined cases: a NULL text stays NULL and has 0 lines, an empty one has 1. Rows without doc_id
    stay as they are and make no other line a repeat. Rows that share a doc_id are told apart by
    their lines: a line they share at the same number counts once. An empty table gives an empty one.
    Columns named n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    removed = removed_lines(docs, edits, min_chars, short_repeats)
    removed = removed.select(F.col("doc_id").alias("_removed_id"), "removed")
    joined = docs.join(removed, docs["doc_id"].cast("bigint") == F.col("_removed_id"), "left")

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in released(batches):
            out, lines, cuts = [], [], []
            for text, places in zip(texts.to_pylist(), gone.to_pylist()):
                own = text.split("\n") if text is not None else []
                drop = {p["line_no"] for p in places or () if p["line_no"] < len(own) and line_digest(own[p["line_no"]]) == (p["node"], p["low"])}
                lines.append(len(own))
                cuts.append(len(drop))
                out.append("\n".join(x for i, x in enumerate(own) if i not in drop) if drop else text)
            yield pa.StructArray.from_arrays(
                [pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(cuts, pa.int64())], ["text", "n_lines", "n_removed"]
            )

    cutter = F.arrow_udf(cut, "text string, n_lines bigint, n_removed bigint")
    result = joined.withColumn("_cut", cutter("text", "removed"))
    values = {"text": F.col("_cut.text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length("_cut.text").cast(docs.schema["n_chars"].dataType)
    columns = [values[c].alias(c) if c in values else F.col(c) for c in docs.columns]
    result = result.select(*columns, F.col("_cut.n_lines").alias("n_lines"), F.col("_cut.n_removed").alias("n_removed"))
    if drop_emptied:
        result = result.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return result
