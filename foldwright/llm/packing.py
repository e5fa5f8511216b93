"""Pack tokenised documents into sequences by hierarchical best fit.

Items are documents or, of longer ones, pieces. Groups of items, told by a hash of
the id, are packed by best fit decreasing on their own and emit their nearly full
bins. What is left goes up: groups merge `FAN_IN` at a time and best fit runs again
over the underfull bins of all of them, until one group is left. Two bins over half
full can never become one, so a bin goes up reopened, as the items it holds. A group
hands on at most `CARRIED` bins, the emptiest, and emits the others as they are: no
task grows with the input, and no item is lost.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwright.llm.words import as_texts, kept, released, split_words, text_slices
from foldwright.session import stored

GROUP_ROWS = 20_000
FAN_IN = 8
CARRIED = 2_000
# A bin counts as nearly full when at most this share of it is free.
SLACK = 1 / 256
# Distinct words whose ids a task keeps between batches; beyond that only those met again stay.
_KEPT_WORDS = 300_000
# Words whose ids are laid out at a time.
_BLOCK_WORDS = 100_000
# Signs that are encoded apart where a word ends in them; those of special tokens are not among them.
_CLOSING = ".,;:!?*&$#%"

PIECES = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] numbers, of each i in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class WordTokenizer:
    """Token ids of whole batches, by a tokenizer file of byte-pair encoding with word ends.

    It must lower-case, drop white space, and never join letters and other signs in one token. Then a
    text's ids are those of its white-space-separated words in turn, so each distinct word
    is encoded once; closing punctuation is encoded apart, and words of letters are encoded many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # Units are what is encoded at once; number 0 is no unit. Their ids lie in one pool.
        self.units = pa.array([""], pa.large_string())
        self.pool = np.zeros(0, np.uint32)
        self.sizes, self.starts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        # A word is one unit or two. Words are numbered in turn; `again` marks those met after they were learned.
        self.known = pa.array([], pa.large_string())
        self.parts = np.zeros((0, 2), np.int32)
        self.again = np.zeros(0, bool)

    def thin(self) -> None:
        """Keep the words met again, which common ones are soon, and their units; forget the others."""
        words, parts = self.known.filter(pa.array(self.again)), self.parts[self.again]
        units = np.union1d(parts, [0])
        names, pool, sizes = self.units.take(pa.array(units)), self.pool[_runs(self.starts[units], self.sizes[units])], self.sizes[units]
        self._forget()
        if len(words) > _KEPT_WORDS // 2:
            return
        self.units, self.pool, self.sizes, self.starts = names, pool, sizes, np.cumsum(sizes) - sizes
        self.known, self.parts = words, np.searchsorted(units, parts).astype(np.int32)
        self.again = np.zeros(len(words), bool)

    def _encode_units(self, units: pa.Array) -> None:
        of_letters = pc.utf8_is_alpha(units)
        letters, others = units.filter(of_letters), [units.filter(pc.invert(of_letters))]
        names, ids, sizes = [self.units], [self.pool], [self.sizes]
        for at in range(0, len(letters), 10_000):
            part = letters.slice(at, 10_000)
            bounds = np.append(np.arange(0, len(part), 500), len(part))
            lines = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), part)
            lines = pc.binary_join(lines, pa.scalar(" ", pa.large_string())).to_pylist()
            for i, encoded in enumerate(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
                held = part.slice(bounds[i], bounds[i + 1] - bounds[i])
                found = np.array(encoded.ids, np.uint32)
                last = np.flatnonzero(self.ends[found]) + 1
                if len(last) == len(held):  # one word end each: the ids can be told apart
                    names.append(held)
                    ids.append(found)
                    sizes.append(np.diff(last, prepend=0))
                else:
                    others.append(held)
        rest = pa.concat_arrays(others)
        for at in range(0, len(rest), 5_000):
            part = rest.slice(at, 5_000)
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
            names.append(part)
            ids.append(np.fromiter((i for f in found for i in f), np.uint32))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        self.units = pa.concat_arrays(names)
        self.pool, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _learn(self, words: pa.Array) -> None:
        heads = pc.ascii_rtrim(words, _CLOSING)
        # Signs are apart only from a letter or number.
        apart = pc.utf8_is_alnum(pc.utf8_slice_codeunits(heads, -1))
        heads = pc.if_else(apart, heads, words)
        closed = np.flatnonzero(pc.less(pc.binary_length(heads), pc.binary_length(words)))
        tails = pc.replace_substring_regex(words.take(pa.array(closed)), rf"(?s)^.*[^{_CLOSING}]", "")
        wanted = pc.unique(pa.concat_arrays([heads, tails]))
        self._encode_units(wanted.filter(pc.invert(pc.is_in(wanted, value_set=self.units))))
        parts = np.zeros((len(words), 2), np.int32)
        parts[:, 0] = pc.index_in(heads, value_set=self.units)
        parts[closed, 1] = pc.index_in(tails, value_set=self.units)
        self.known = pa.concat_arrays([self.known, words])
        self.parts = np.concatenate([self.parts, parts])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn.

        Words are looked up once for all texts; ids are laid out for about `_BLOCK_WORDS` words at a time.
        """
        # Special tokens are found before lower-casing, so a text that may hold one keeps its case.
        plain = not pc.any(pc.match_substring(texts, "<|")).as_py()
        words, bounds = split_words(texts, lower=plain)
        coded = words.dictionary_encode()
        codes, distinct = np.asarray(coded.indices), coded.dictionary
        if len(self.known) > _KEPT_WORDS:
            self.thin()
        number = np.array(pc.fill_null(pc.index_in(distinct, value_set=self.known), -1))
        new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        if len(new):
            number[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(distinct.take(pa.array(new)))
        parts = self.parts[number]
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _BLOCK_WORDS, "right")) - 1)
            units = parts[codes[bounds[first] : bounds[last]]].ravel()
            counts = self.sizes[units]
            ends = np.concatenate([[0], np.cumsum(counts)])
            ids, cuts = self.pool[_runs(self.starts[units], counts)], ends[2 * (bounds[first : last + 1] - bounds[first])]
            yield from (ids[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
            first = last


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """`PIECES` of every document: its ids and `end_id`, cut every `capacity` ids.

    `row` tells rows with one doc_id apart. The path must exist on every executor.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tasks run beside each other already; threads of the tokenizer would only add memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # One encoder a Python worker, so that later tasks find the common words learned.
        encoder = kept(tokenizer_path, lambda: WordTokenizer(tokenizer_path))
        for batch in released(batches, keep=tokenizer_path):
            for at, size in text_slices(batch.column(2), rows=1024, size=4 << 20):
                part = batch.slice(at, size)
                encoded = encoder.encode(as_texts(part.column(2)))
                rows = {n: [] for n in ("doc_id", "row", "piece", "start", "length", "ids_crc32")}
                keys, numbers = part.column(0).to_pylist(), part.column(1).to_pylist()
                for key, number, ids in zip(keys, numbers, encoded):
                    own = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        held = own[start : start + capacity]
                        for name, value in zip(rows, (key, number, piece, start, len(held), zlib.crc32(held.tobytes()))):
                            rows[name].append(value)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))
        encoder.thin()  # between tasks only common words stay

    keyed = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), "text")
    return keyed.mapInArrow(cut, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: indexes of the items of each bin, in the order they were put."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}  # free space -> bins
    spaces = 0  # bit s set: some bin has s free
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                spaces &= ~(1 << space)
            bins[at].append(i)
        else:
            space, at = capacity, len(bins)
            bins.append([i])
        rest = space - size
        if rest:
            free.setdefault(rest, []).append(at)
            spaces |= 1 << rest
    return bins


def _pack(groups: DataFrame, capacity: int, last: bool) -> DataFrame:
    """Pack each group; `_done` tells emitted bins from items that go up."""
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([*groups.schema.fields, *added, T.StructField("_done", T.BooleanType())])

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "row", "piece"], na_position="first").reset_index(drop=True)
        sizes = pdf["length"].tolist()
        bins = best_fit(sizes, capacity)
        free = [capacity - sum(sizes[i] for i in held) for held in bins]
        roomy = [b for b, space in enumerate(free) if space > capacity * SLACK]
        roomy = sorted(roomy, key=lambda b: -free[b])[: 0 if last else CARRIED]
        up = set(roomy)
        sequence, offset, done = [0] * len(sizes), [0] * len(sizes), [True] * len(sizes)
        first = (int(key[0]) << 58) + (int(key[1]) << 24)  # a group has fewer than 2**24 bins
        for b, held in enumerate(bins):
            at = 0
            for i in held:
                sequence[i], offset[i], done[i] = first + b, at, b not in up
                at += sizes[i]
        return pdf.assign(sequence_id=sequence, offset=offset, _done=done)

    return groups.groupBy("_level", "_group").applyInPandas(pack, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """Every piece of every document with its place: `PIECES`, sequence_id, offset.

    Sequences hold at most `capacity` ids and have no gaps. Full pieces are sequences
    of their own. Defined cases: a NULL or empty text is one piece, `end_id` alone; rows
    that share a doc_id, or have none, are packed each; the order of rows does not change
    the number of pieces, but ties between equal lengths go by doc_id; an empty table
    gives no rows. Columns other than doc_id and text are not looked at.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    full = F.col("length") == capacity
    alone = -1 - F.monotonically_increasing_id()  # the packed ones count from 0 up
    done = [pieces.where(full).withColumn("sequence_id", alone).withColumn("offset", F.lit(0).cast("bigint"))]
    items = pieces.where(~full)
    groups = max(1, -(-items.count() // GROUP_ROWS))
    group = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups))
    level, names = 0, [*pieces.columns, "sequence_id", "offset"]
    items = items.withColumn("_level", F.lit(0)).withColumn("_group", group)
    while True:
        packed = _pack(items, capacity, last=groups == 1)
        if groups == 1:
            done.append(packed.select(names))
            break
        packed = stored(packed, "packed")
        done.append(packed.where("_done").select(names))
        level, groups = level + 1, -(-groups // FAN_IN)
        up = packed.where("not _done").drop("sequence_id", "offset", "_done")
        items = up.withColumn("_level", F.lit(level)).withColumn(
            "_group", F.floor(F.col("_group") / FAN_IN).cast("bigint")
        )
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("row")
