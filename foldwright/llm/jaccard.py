"""Documents whose sets of word shingles are alike, by a parity-sketch join.

Every shingle hash XORs into a bit sketch: it flips one bit of one word of the sketch, and
XORs itself into that word's check value. Two sketches differ in at most as many bits as
the sets differ in shingles, and words without a differing shingle are equal. Sets of
similarity t differ in at most D = (1 - t) / (1 + t) * (sum of sizes) shingles, so of
s = D + 1 + E words at least E + 1 are equal. Sizes are cut into bands, each with its own s;
a set is sketched for its own band and, when it may have a partner in the next, for that one.
Sets that agree in one word of one sketch are candidates. Words that hold hardly any shingles agree
by chance, so a set leaves its poor words out unless it has more than E: of E + 1 equal
words, one is then not poor. Candidates are compared, first by their sketches, then by their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.linking import link_classes
from foldwright.llm.words import as_texts, mixed, released, shingle_sets, sliced, text_slices
from foldwright.session import scratch_space, stored

# Sketch words a task holds before it joins equal ones on its own.
_HELD = 1_000_000
# Ids of candidates up to which they are broadcast to find their texts.
_BROADCAST_IDS = 200_000
_SALT = np.uint64(0xD6E8FEB86659FD93)

_ROWS = "is_word boolean, key bigint, node bigint, centre bigint, low bigint, size bigint"


class Bands:
    """Size bands and the number of sketch words of each."""

    def __init__(self, similarity: Fraction, growth: float = 1.25):
        self.similarity = similarity
        growth = max(growth, float(1 / similarity))  # so that partners are at most one band apart
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(lows[-1] * growth)))
        self.lows = np.array(lows, np.int64)
        self.most = [self.apart(2 * (high - 1)) for high in lows[1:]]
        spare = [2 + d // 50 for d in self.most]
        self.spare = np.array(spare, np.int64)  # E
        self.words = np.array([d + 1 + e if d else 0 for d, e in zip(self.most, spare)], np.int64)
        # A word is poor below this number of shingles: it follows the mean of the band's smallest sets.
        mean = [low * float(similarity) / max(w, 1) for low, w in zip(lows, self.words)]
        self.rich = np.array([1 + (x >= 4) + (x >= 6) for x in mean], np.int64)

    def apart(self, total: int) -> int:
        """How many shingles linked sets of `total` shingles together differ in, at most."""
        return int(total * (1 - self.similarity) / (1 + self.similarity))

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(rows, bands)]: the sets to sketch and the band, for own and next bands."""
        own = np.searchsorted(self.lows, sizes, "right") - 1
        rows = np.flatnonzero(sizes > 0)
        # A partner in the next band has at least its lowest size, and this set t times that.
        t = self.similarity
        reaches = sizes[rows] * t.denominator >= self.lows[own[rows] + 1] * t.numerator
        return [(rows, own[rows]), (rows[reaches], own[rows[reaches]] + 1)]


def sketch(values: np.ndarray, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, word number, parity bits, check, shingles) of all words that hold a shingle.

    `values` are sorted shingle hashes inside each owner; `words` the number of words
    of each value's sketch. A value's leading bits tell its word, its last six the bit.
    """
    at = ((values >> np.uint64(32)) * words.astype(np.uint64)) >> np.uint64(32)
    if len(values) == 0:
        return owner, at.astype(np.int64), values, values, owner
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])]))
    bits = np.left_shift(np.uint64(1), values & np.uint64(63))
    parity = np.bitwise_xor.reduceat(bits, first)
    check = np.bitwise_xor.reduceat(mixed(values + _SALT), first)
    held = np.diff(np.append(first, len(values)))
    return owner[first], at[first].astype(np.int64), parity, check, held


def _word_keys(flat: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): a key for each sketch word of each set."""
    sizes = np.diff(bounds)
    keys, rows = [], []
    for chosen, band in bands.of(sizes):
        kept = bands.words[band] > 0
        chosen, band = chosen[kept], band[kept]
        if not len(chosen):
            continue
        counts = sizes[chosen]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], counts) + np.repeat(bounds[chosen], counts)
        owner = np.repeat(np.arange(len(chosen)), counts)
        words = bands.words[band]
        own, number, parity, check, held = sketch(flat[at], owner, np.repeat(words, counts))
        rich = held >= bands.rich[band[own]]
        poor = words - np.bincount(own[rich], minlength=len(chosen))
        all_words = poor > bands.spare[band]
        place = mixed(band[own].astype(np.uint64) * np.uint64(1 << 40) + number.astype(np.uint64))
        taken = rich | all_words[own]
        keys.append(mixed(mixed(parity + place) + check)[taken])
        rows.append(chosen[own[taken]])
        for i in np.flatnonzero(all_words & (np.bincount(own, minlength=len(chosen)) < words)):
            gone = np.setdiff1d(np.arange(words[i]), number[own == i])
            place = mixed(np.uint64(int(band[i]) << 40) + gone.astype(np.uint64))
            keys.append(mixed(mixed(place)))
            rows.append(np.full(len(gone), chosen[i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _joined_here(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) and, where another node of the task has the key, the least of them."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    same = keys[1:] == keys[:-1]
    kept = np.concatenate([[True], ~same | (nodes[1:] != nodes[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, nodes = keys[kept], nodes[kept]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    least = nodes[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(keys) else nodes
    return keys, nodes, least


def sketch_table(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """`_ROWS`: for each document its set's size and digest, for each sketch word its key.

    Documents of one task with equal sets are sketched once, and words that several of
    them share are joined in the task, so that a very frequent word is one row a task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, count = [], set(), 0

        def flush() -> pa.RecordBatch:
            keys, nodes, least = _joined_here(*(np.concatenate(x) for x in zip(*held)))
            n = len(keys)
            none = pa.nulls(n, pa.int64())
            centre = pa.array(least, mask=least == nodes)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(n, bool)), pa.array(keys.view(np.int64)), pa.array(nodes), centre, none, none], names
            )

        names = [c.split()[0] for c in _ROWS.split(", ")]
        for batch in released(batches):
            for start, size in text_slices(batch.column(1), rows=512, size=1 << 20):
                part = batch.slice(start, size)
                flat, bounds = shingle_sets(as_texts(part.column(1)), width)
                nodes = np.asarray(part.column(0), np.int64)
                sizes = np.diff(bounds)
                digests = [xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                n = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, bool)), pa.array(halves[:, 0]), pa.array(nodes), pa.nulls(n, pa.int64()), pa.array(halves[:, 1]), pa.array(sizes)],
                    names,
                )
                fresh = [i for i, d in enumerate(digests) if d not in seen and not seen.add(d)]
                if len(seen) > 1_000_000:
                    seen.clear()
                counts = np.zeros(n, np.int64)
                counts[fresh] = sizes[fresh]
                new_bounds = np.concatenate([[0], np.cumsum(counts)])
                keep = np.repeat(counts > 0, sizes)
                keys, own = _word_keys(flat[keep], new_bounds, bands)
                held.append((keys, nodes[own]))
                count += len(keys)
                if count > _HELD:
                    yield from sliced(flush())
                    held, count = [], 0
        if count:
            yield from sliced(flush())

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rows, _ROWS)


def _verifier(docs: DataFrame, width: int, bands: Bands):
    """Function from pairs (a, b) to those whose sets are similar enough."""
    t = bands.similarity

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for start, size in text_slices(batch.column(2), rows=256, size=1 << 20):
                part = batch.slice(start, size)
                left, left_at = shingle_sets(as_texts(part.column(2)), width)
                right, right_at = shingle_sets(as_texts(part.column(3)), width)
                ok = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    a, b = left[left_at[i] : left_at[i + 1]], right[right_at[i] : right_at[i + 1]]
                    ok[i] = _similar(a, b, t, bands.apart(len(a) + len(b)))
                yield part.select([0, 1]).filter(pa.array(ok))

    def verify(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = _texts_of(docs, nodes)
        sides = [texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in ("a", "b")]
        both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(alike, "a bigint, b bigint").distinct()

    return verify


def folded_sketch(values: np.ndarray) -> bytes:
    """A parity sketch of 2 to 4 bits a shingle, its length a power of two.

    A shorter sketch of the same set is the longer one folded by exclusive or, so sketches of all
    lengths can be compared.
    """
    words = 1 << max(0, (len(values) - 1).bit_length() - 5)
    line = np.zeros(words, np.uint64)
    at = ((values >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
    np.bitwise_xor.at(line, at, np.left_shift(np.uint64(1), values & np.uint64(63)))
    return line.tobytes()


def _folded(sketch: bytes, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, words), axis=0)


class _NearSketches:
    """Bound for `link_classes`: sizes and Hamming distance that linked sets cannot exceed."""

    def __init__(self, similarity: Fraction):
        self.similarity = similarity
        self.held: tuple = (None, None)

    def __call__(self, sketches: list, sizes: np.ndarray, n: int, others: np.ndarray) -> np.ndarray:
        if self.held[0] is not sketches:
            words = min(len(x) for x in sketches) // 8
            self.held = (sketches, np.stack([_folded(x, words) for x in sketches]))
        lines, t = self.held[1], self.similarity
        total = sizes[others] + sizes[n]
        apart = total * (t.denominator - t.numerator) // (t.denominator + t.numerator)
        fits = np.minimum(sizes[others], sizes[n]) * t.denominator >= np.maximum(sizes[others], sizes[n]) * t.numerator
        far = np.bitwise_count(lines[others] ^ lines[n]).sum(axis=1, dtype=np.int64)
        return fits & (far <= apart)


def _sketches_of(docs: DataFrame, width: int):
    """Function from (node) to (node, size, sketch) of their sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for start, size in text_slices(batch.column(1), rows=512, size=1 << 20):
                part = batch.slice(start, size)
                flat, bounds = shingle_sets(as_texts(part.column(1)), width)
                lines = [folded_sketch(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds)), pa.array(lines, pa.binary())], ["node", "size", "sketch"]
                )

    def sketches(nodes: DataFrame) -> DataFrame:
        return _texts_of(docs, nodes).mapInArrow(rows, "node bigint, size bigint, sketch binary")

    return sketches


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the wanted documents."""
    ids = stored(nodes.select(F.col("node").alias("doc_id")), "ids")
    if ids.count() <= _BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return texts.withColumnRenamed("doc_id", "node")


def _similar(a: np.ndarray, b: np.ndarray, t: Fraction, apart: int) -> bool:
    if not len(a) or not len(b):
        return False
    # The sketches bound the difference from below: most unlike pairs end here.
    words = np.uint64(apart + 1)
    halves = []
    for values in (a, b):
        line = np.zeros(int(words), np.uint64)
        at = ((values >> np.uint64(32)) * words) >> np.uint64(32)
        np.bitwise_xor.at(line, at.astype(np.int64), np.left_shift(np.uint64(1), values & np.uint64(63)))
        halves.append(line)
    if int(np.bitwise_count(halves[0] ^ halves[1]).sum()) > apart:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * t.denominator >= (len(a) + len(b) - shared) * t.numerator


def similar_documents(
    docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5)
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text).

    Words are lower-cased in A-Z and split at space and 0x09-0x0D; a set holds the
    distinct shingles of `width` words of the whole text, or the whole sequence where it
    is shorter. Documents link at a Jaccard similarity of at least `similarity`;
    component_id is the smallest doc_id reachable by links.

    Defined cases: NULL, empty and word-free texts have no shingles and link with
    nothing, themselves included, so each is its own component. Rows that share a doc_id are one node: what one of
    them links to, all do; rows without doc_id have no component and link with nothing.
    Repeated rows stay. An empty table gives an empty result. Other columns are not looked at.
    """
    with scratch_space(docs.sparkSession):
        bands = Bands(similarity)
        named = docs.where("doc_id is not null")
        # Partitions for the sketches as the files give them; very long texts are handled whole.
        rows = stored(sketch_table(named, width, bands), "sketches")
        sets = rows.where("not is_word").select(F.col("node").alias("doc_id"), "key", "low", "size")
        least = sets.where("size > 0").groupBy("key", "low").agg(F.min("doc_id").alias("a"))
        copies = sets.where("size > 0").join(least, ["key", "low"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
        words = rows.where("is_word")
        here = words.where("centre is not null")
        bucket = Window.partitionBy("key")
        across = (
            words.where("centre is null")
            .select("key", "node", F.min("node").over(bucket).alias("centre"), F.max("node").over(bucket).alias("_most"))
            .where("centre <> _most")
        )
        members = here.select("key", "node").unionByName(here.select("key", F.col("centre").alias("node")))
        members = members.unionByName(across.select("key", "node")).withColumn("is_index", F.lit(True))
        verify, sketches = _verifier(named, width, bands), _sketches_of(named, width)
        labels = link_classes(members, verify, sketches, _NearSketches(similarity), copies)
        result = sets.select("doc_id", F.col("size").alias("n_shingles"))
        result = result.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
        )
        unnamed = docs.where("doc_id is null").withColumn("doc_id", F.lit(0).cast("bigint"))
        unnamed = sketch_table(unnamed, width, bands).where("not is_word")
        nothing = F.lit(None).cast("bigint")
        unnamed = unnamed.select(nothing.alias("doc_id"), F.col("size").alias("n_shingles"), nothing.alias("component_id"))
        return stored(result.unionByName(unnamed), "similar", keep=True)


def keep_one_per_group(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the smallest doc_id stays.

    Rows without doc_id stay. Of rows that share the kept doc_id all stay.
    """
    groups = similar_documents(docs, **settings).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti")
