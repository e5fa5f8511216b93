"""Words, their hashes and word shingles of whole Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D; only A-Z is lower-cased.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_Batch = TypeVar("_Batch")
_Held = TypeVar("_Held")

# What this Python worker keeps between tasks of one kind, by name.
_kept: dict[str, object] = {}

# What separates words, as a pattern of Java, RE2 and Python alike.
SPACE = r"[\x20\x09-\x0D]+"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xFF51AFD7ED558CCD)
_MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
_HALF = np.uint64(32)
_SHIFT = np.uint64(33)


def word_count(text: Column) -> Column:
    """Number of words as a column expression; 0 for NULL.

    Equals the number of word starts: places where a word byte follows the start or a space.
    """
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on every bit."""
    values = values ^ (values >> _SHIFT)
    values = values * _MIX_A
    values = values ^ (values >> _SHIFT)
    values = values * _MIX_B
    return values ^ (values >> _SHIFT)


def as_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One Arrow array of text without NULLs (NULL becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    # Casting a slice leaves offsets that do not begin at 0, which some kernels misread: copy.
    return texts.take(pa.array(np.arange(len(texts))))


def _give_back() -> None:
    """Return memory that neither Arrow nor the C library uses to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, others may not
    if trim:
        trim(0)


def kept(name: str, make: Callable[[], _Held]) -> _Held:
    """What `make` returns, made once a worker and kept until batches of other work are `released`."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def released(batches: Iterator[_Batch], keep: str | None = None) -> Iterator[_Batch]:
    """The batches, unchanged; after each, memory that is no longer used goes back to the system.

    Python workers outlive their tasks, and Arrow's pool and the C library's heap would keep what the
    largest batch took. What tasks of another kind `kept` goes first, but for `keep`.
    """
    for name in [n for n in _kept if n != keep]:
        del _kept[name]
    for batch in batches:
        yield batch
        del batch
        _give_back()
    _give_back()


def sliced(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `rows` rows, so that the JVM never holds it whole."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def text_slices(texts: pa.Array, rows: int, size: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive slices of at most `rows` rows and `size` bytes; a longer text is one by itself."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(ends):
        limit = size + (ends[at - 1] if at else 0)
        last = min(at + rows, max(at + 1, int(np.searchsorted(ends, limit, "right"))))
        yield at, last - at
        at = last


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(words, bounds): the words of text i are words[bounds[i]:bounds[i + 1]]."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten()
    kept = pc.greater(pc.binary_length(words), 0)
    ends = np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    inside = np.concatenate([[0], np.cumsum(np.asarray(kept), dtype=np.int64)])
    return words.filter(kept), inside[ends]


def coded_words(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """(codes, distinct words): word i is distinct[codes[i]]."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word of the batch is hashed once."""
    codes, distinct = coded_words(words)
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))
    return table[codes]


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): hashes of all runs of `width` words of each text.

    A text of fewer words is one shingle as a whole; a text without words has none.
    """
    sizes = np.diff(bounds)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    # Where each shingle begins among the words.
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(bounds[:-1], counts)
    lengths = np.minimum(np.repeat(sizes, counts), width)
    value = lengths.astype(np.uint64) * _STEP
    with np.errstate(over="ignore"):
        for i in range(width):
            if len(hashes) == 0:
                break
            inside = lengths > i
            word = hashes[np.minimum(at + i, len(hashes) - 1)]
            value = np.where(inside, mixed(value * _STEP + word), value)
    return value, starts


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each text's values and drop repeats."""
    parts, counts = [], np.zeros(len(bounds) - 1, np.int64)
    for i in range(len(counts)):
        own = values[bounds[i] : bounds[i + 1]]
        if len(own):
            own = np.unique(own)
            parts.append(own)
            counts[i] = len(own)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, bounds) of each text."""
    words, bounds = split_words(texts)
    shingles, starts = shingle_hashes(word_hashes(words), bounds, width)
    return distinct_sorted(shingles, starts)
