"""Approximate nearest neighbours by cosine from randomly rotated one-bit codes.

Unit vectors are taken relative to the centre of their block, turned by one random rotation
and cut to the signs of their components, packed eight to a byte. The inner product of a
query with the signs, corrected by two scalars kept with each code (the residual's length,
and its inner product with its own signs), estimates the inner product with the vector,
and its error has a known spread. Vectors whose estimate plus error reaches the k-th best
estimate less error, and the k-th score found elsewhere, are reranked by their true cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.llm.blocks import Packed, choose_pivots, search, usable


def rotation(dimension: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


class OneBitCodes:
    """Codes and correction scalars of one block."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        self.centre = vectors.mean(axis=0)
        residual = (vectors - self.centre) @ turn
        self.length = np.linalg.norm(residual, axis=1)
        unit = residual / np.where(self.length > 0, self.length, 1)[:, None]
        self.bits = np.packbits(unit >= 0, axis=1)
        self.dimension = vectors.shape[1]
        # Inner product of the unit residual and its signs, each sign 1 / sqrt(dimension).
        self.agreement = np.maximum(np.abs(unit).sum(axis=1) / np.sqrt(self.dimension), 1e-9)
        self.with_centre = (vectors - self.centre) @ self.centre + self.centre @ self.centre

    def estimate(self, queries: np.ndarray, turn: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
        """(inner products, error bounds) of all queries and all coded vectors."""
        residual = queries - self.centre
        turned = residual @ turn
        signs = np.unpackbits(self.bits, axis=1, count=self.dimension).astype(np.float32) * 2 - 1
        raw = (turned.astype(np.float32) @ signs.T) / np.sqrt(self.dimension)
        estimate = self.length * raw / self.agreement
        # <x, q> = <x - c, q - c> + <x, c> + <c, q - c>, and <x, c> is kept.
        estimate = estimate + self.with_centre + (residual @ self.centre)[:, None]
        off = np.sqrt(np.maximum(1 - self.agreement**2, 0)) / self.agreement / np.sqrt(max(self.dimension - 1, 1))
        error = spread * np.linalg.norm(residual, axis=1)[:, None] * (self.length * off)[None, :]
        return estimate, error + 1e-6


def _rerank(k: int, turn: np.ndarray, spread: float):
    held: dict[int, OneBitCodes] = {}

    def visit(query: Packed, least: np.ndarray, block: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = id(block)
        if key not in held:  # one block at a time, asked by many batches
            held.clear()
            held[key] = OneBitCodes(block.vectors, turn)
        estimate, error = held[key].estimate(query.vectors, turn, spread)
        low = estimate - error
        # One more than k, as the query itself may be among them.
        n = min(k + 1, low.shape[1])
        sure = np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n]
        if n <= k:
            sure = np.full(len(sure), -np.inf)
        rows, places = np.nonzero(estimate + error >= np.maximum(sure, least)[:, None])
        scores = np.einsum("ij,ij->i", query.vectors[rows], block.vectors[places])
        return rows, places, scores

    return visit


def nearest_by_cosine(
    vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 32, spread: float = 3.0, seed: int = 11
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest vectors found, by cosine.

    `vectors` and `queries` have vec_id and embedding; a query is not its own candidate; equal scores
    rank by smaller vec_id. Every vector is coded and every score is the cosine of the original
    vectors in double precision. A neighbour is missed only when its estimate errs by more than
    `spread` standard errors.

    Defined cases: vectors that are NULL, empty, zero, or hold a NULL or non-finite component take no part,
    nor do rows without vec_id or vectors of another length than the first by vec_id; fewer
    than `k` candidates give all; of rows that share a query's vec_id the smallest vector is
    asked and none is a candidate for it; rows that share another vec_id are candidates each. No
    vectors give no rows. Other columns are not looked at.
    """

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vector in batch.column(1).to_pylist():
                vector = np.array(vector, float)
                vector /= np.abs(vector).max()  # keeps squares in range
                out.append(vector / np.linalg.norm(vector))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "vector"])

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), nonzero=True))
        rows = rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
        return rows.mapInArrow(unit, "vec_id bigint, vector array<double>")

    held = prepared(vectors)
    first = held.orderBy("vec_id").select(F.size("vector")).first()
    size = first[0] if first else 0
    held = held.where(F.size("vector") == size)
    asked = prepared(queries).where(F.size("vector") == size)
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    table = choose_pivots(held, pivots)
    return search(held, asked, table, k, _rerank(k, rotation(size, seed) if size else np.zeros((0, 0)), spread))
