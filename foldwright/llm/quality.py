"""A quality score from supervised subword embeddings.

Features of a text are its words, the n-grams of characters of each word with its ends
marked, and pairs of neighbouring words (a word that follows itself is one feature
of its own, whatever the word). Each is hashed to a row of an embedding table; a
document is the mean of its rows, and a softmax over the classes follows. Table and
output weights are learned together by stochastic gradient descent in numpy, from a
bounded sample of labelled documents. As mean and output are linear, scoring needs
one number per row: its product with the difference of the class weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.words import as_texts, coded_words, mixed, released, split_words, text_slices

_PAIR = np.uint64(0xA0761D6478BD642F)
_REPEAT = np.uint64(0xE7037ED1A0B428DB)
_GRAM = np.uint64(0x8EBC6AF09C88C6E3)
# The shares of a text's rows are small; their steps are lifted by this factor.
_LIFT = 200.0


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; `rows` is a power of 2."""

    rows: int = 1 << 16
    width: int = 16
    shortest: int = 3
    longest: int = 5


@dataclass
class QualityModel:
    table: np.ndarray  # rows x width
    output: np.ndarray  # width x 2
    bias: float  # added to the log odds of class 1
    shape: Shape

    def odds(self) -> np.ndarray:
        """What each row adds to the log odds of class 1."""
        return (self.table @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; false for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def word_grams(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(rows, word numbers) of all character n-grams of the words, ends marked '<' and '>'."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, shape.longest + 1):
        if len(codes) < n:
            break
        size = len(codes) - n + 1
        value = value[:size] * _GRAM + codes[n - 1 :] + np.uint64(n)
        if n >= shape.shortest:
            inside = owner[:size] == owner[n - 1 :]
            rows.append((mixed(value[inside]) & np.uint64(shape.rows - 1)).astype(np.int64))
            owners.append(owner[:size][inside])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(owners)


class Features:
    """The features of a batch of texts: codes of distinct words, and rows of pairs."""

    def __init__(self, texts: pa.Array, shape: Shape):
        words, self.bounds = split_words(texts, lower=False)
        self.codes, self.distinct = coded_words(words)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.distinct), np.uint64, len(self.distinct))
        last = np.uint64(shape.rows - 1)
        self.word_rows = (mixed(hashes) & last).astype(np.int64)
        self.gram_rows, self.gram_words = word_grams(self.distinct, shape)
        # Pair i joins words i and i + 1; pairs across texts are left out by their bounds.
        own = hashes[self.codes]
        pair = np.where(own[:-1] == own[1:], _REPEAT, mixed(own[:-1] * _PAIR + own[1:])) if len(own) else own
        self.pair_rows = (mixed(pair) & last).astype(np.int64)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, counts) of text i."""
        a, b = self.bounds[i], self.bounds[i + 1]
        used = np.bincount(self.codes[a:b], minlength=len(self.distinct))
        grams = used[self.gram_words]
        taken = grams > 0
        pairs = self.pair_rows[a : max(b - 1, a)]
        rows = np.concatenate([np.repeat(self.word_rows, used), np.repeat(self.gram_rows[taken], grams[taken]), pairs])
        return np.unique(rows, return_counts=True)

    def means(self, odds: np.ndarray) -> np.ndarray:
        """Mean of `odds` over the features of each text; 0 where it has none."""
        n = len(self.distinct)
        word_sum = odds[self.word_rows] + np.bincount(self.gram_words, odds[self.gram_rows], n)
        word_count = 1 + np.bincount(self.gram_words, minlength=n)
        total = _sums(word_sum[self.codes], self.bounds) + _sums(odds[self.pair_rows], self.bounds, 1)
        count = _sums(word_count[self.codes].astype(float), self.bounds) + np.maximum(np.diff(self.bounds) - 1, 0)
        return total / np.maximum(count, 1)


def _sums(values: np.ndarray, bounds: np.ndarray, short: int = 0) -> np.ndarray:
    """Sum of each slice, less its last `short` values."""
    running = np.concatenate([[0.0], np.cumsum(values)])
    last = len(running) - 1
    ends = np.maximum(bounds[1:] - short, bounds[:-1])
    return running[np.minimum(ends, last)] - running[np.minimum(bounds[:-1], last)]


def agreed_labels(labels: DataFrame, keep: Column | None = None) -> DataFrame:
    """(doc_id, label): the quality of each labelled id; ids with contradicting labels are left out."""
    agreed = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("_other")
    )
    agreed = agreed.where("label = _other").select("doc_id", "label")
    return agreed if keep is None else agreed.where(keep)


def training_rows(agreed: DataFrame, per_class: int) -> DataFrame:
    """At most `per_class` rows (doc_id, label) of each class, picked by hash of the id."""
    parts = [agreed.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 1000,
    keep: Column | None = None,
    epochs: int = 12,
    rate: float = 1.0,
    seed: int = 5,
    shape: Shape = Shape(),
) -> QualityModel:
    """Learn label 1 of `labels` (doc_id, quality) from the texts of `docs` (doc_id, text).

    The sample holds at most `per_class` documents of each class; that bounds what the driver
    holds; of rows that share an id the smallest text is taken. `keep` restricts the ids that may be used. The share of each class among all
    usable labels corrects the log odds for the even sample. The fit depends on ids, texts
    and `seed` alone. Without labels of both classes every score is the share of class 1, or
    one half without any.
    """
    agreed = agreed_labels(labels, keep)
    sample = F.broadcast(training_rows(agreed, per_class))  # at most 2 * per_class rows
    rows = docs.where("doc_id is not null").select("doc_id", "text").join(sample, "doc_id")
    # One row an id, so that the bound holds whatever repeats.
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for at, size in text_slices(batch.column(1), rows=64, size=1 << 20):
                part = batch.slice(at, size)
                own = Features(as_texts(part.column(1)), shape)
                found = [own.of(i) for i in range(part.num_rows)]
                columns = [
                    pa.array([r.astype("<i4").tobytes() for r, _ in found], pa.binary()),
                    pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["doc_id", "label", "rows", "counts"])

    held = rows.select(F.col("doc_id").cast("bigint"), "text", F.col("label").cast("int")).mapInArrow(
        features, "doc_id bigint, label int, rows binary, counts binary"
    )
    examples = sorted((r["doc_id"], r["label"], bytes(r["rows"]), bytes(r["counts"])) for r in held.collect())
    counts = {r["label"]: r["count"] for r in agreed.groupBy("label").count().collect()}
    return _descend(examples, (counts.get(0, 0), counts.get(1, 0)), epochs, rate, seed, shape)


def _descend(examples: list, totals: tuple[int, int], epochs: int, rate: float, seed: int, shape: Shape) -> QualityModel:
    random = np.random.default_rng(seed)
    table = (random.random((shape.rows, shape.width), dtype=np.float32) - 0.5) * np.float32(2 / shape.width)
    output, bias = np.zeros((shape.width, 2), np.float32), np.zeros(2, np.float32)
    sampled = [sum(1 for e in examples if e[1] == c) for c in (0, 1)]
    if not all(sampled):
        share = (totals[1] + 0.5) / (sum(totals) + 1) if sum(totals) else 0.5
        return QualityModel(table * 0, output, math.log(share / (1 - share)), shape)
    data = []
    for _, label, rows, counts in examples:
        rows, counts = np.frombuffer(rows, "<i4"), np.frombuffer(counts, "<i4").astype(np.float32)
        data.append((label, rows, counts / max(counts.sum(), 1)))
    steps, step = epochs * len(data), 0
    for _ in range(epochs):
        for i in random.permutation(len(data)):
            label, rows, shares = data[i]
            now = rate * (1 - step / steps)
            step += 1
            mean = shares @ table[rows] if len(rows) else np.zeros(shape.width, np.float32)
            logits = mean @ output + bias
            logits -= logits.max()
            error = np.exp(logits)
            error /= error.sum()
            error[label] -= 1
            back = output @ error
            output -= now * np.outer(mean, error)
            bias -= now * 0.1 * error
            if len(rows):
                # As each row counts by its share, the step is scaled to the mean, not to each row.
                table[rows] -= (now * _LIFT) * shares[:, None] * back
    prior = math.log((totals[1] + 0.5) / (totals[0] + 0.5)) - math.log(sampled[1] / sampled[0])
    return QualityModel(table, output, float(bias[1] - bias[0]) + prior, shape)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Add `score`, the probability of class 1 from the whole of `text`; a `score` column is replaced.

    Defined cases: NULL, empty and word-free texts score by the bias alone; the longest texts
    are read whole; repeated rows score alike; an empty table stays empty.
    """
    # One double a row of the table: a fixed size, whatever the data.
    odds = docs.sparkSession.sparkContext.broadcast(model.odds())
    bias, shape = model.bias, model.shape

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in released(batches):
            parts = [np.zeros(0)]
            for at, size in text_slices(texts, rows=128, size=1 << 20):
                own = Features(as_texts(texts.slice(at, size)), shape)
                logits = np.clip(own.means(odds.value) + bias, -500, 500)
                parts.append(1 / (1 + np.exp(-logits)))
            yield pa.array(np.concatenate(parts))

    return docs.withColumn("score", F.arrow_udf(score, "double")(F.col(text)))
