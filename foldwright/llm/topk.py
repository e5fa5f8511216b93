"""Exact top-k inner products by elimination with a pivot table.

Every vector keeps its distances to many pivots. By the triangle inequality no vector is
nearer to a query than the largest difference of their distances to a pivot, so the inner
product is at most (|q|^2 + |x|^2 - difference^2) / 2. Candidates are evaluated in the
order of that bound until the next bound is below the k-th score found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwright.llm.blocks import Packed, choose_pivots, search, usable

# Candidates evaluated between two looks at the k-th scores.
_STEP = 256
# Pivots are looked at in groups of this size; a group that rules out under 1 / _WORTH of the rows is the last.
_GROUP = 4
_WORTH = 16


def _gaps(query: Packed, block: Packed, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds on inner products, block rows that some query may still need).

    Pivots that tell batch and block apart come first. Where they hardly rule out rows, a product
    costs less than the bounds of further pivots, and those so far hold as well.
    """
    own = np.einsum("ij,ij->i", query.vectors, query.vectors)[:, None]
    norms = own + np.einsum("ij,ij->i", block.vectors, block.vectors)[None, :]
    norms += 1e-9 * (norms + 1)  # rounding must not rule out what fits
    asked, held = query.distances.T.astype(np.float32), block.distances.T.astype(np.float32)
    # What single precision may add to a difference of distances.
    blur = np.float32(4 * np.finfo(np.float32).eps * max(query.distances.max(), block.distances.max()))
    best = np.argsort(-np.abs(asked.mean(axis=1) - held.mean(axis=1)), kind="stable")
    left = np.arange(len(block.ids))
    gap = np.zeros(norms.shape, np.float32)
    for start in range(0, len(best), _GROUP):
        away = np.empty_like(gap)
        for i in best[start : start + _GROUP]:
            np.subtract(asked[i][:, None], held[i][None, :], out=away)
            np.abs(away, out=away)
            np.maximum(gap, away, out=gap)
        bound = (norms - np.maximum(gap - blur, 0).astype(float) ** 2) / 2
        still = (bound >= least[:, None]).any(axis=0)
        left, gap, norms, held, bound = left[still], gap[:, still], norms[:, still], held[:, still], bound[:, still]
        if len(left) * _WORTH > len(still) * (_WORTH - 1) or not len(left):
            break
    return bound, left


def _eliminate(k: int):
    def visit(query: Packed, least: np.ndarray, block: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bound, left = _gaps(query, block, least)
        # Candidates come in the order of the highest bound that any query of the batch gives them.
        best = bound.max(axis=0, initial=-np.inf)
        order = np.argsort(-best, kind="stable")
        bound, left, kth = bound[:, order], left[order], least.copy()
        top = np.full((len(query.ids), k + 1), -np.inf)
        parts, at = [], 0
        while at < len(left) and (bound[:, at:] >= kth[:, None]).any():
            part = slice(at, at + _STEP)
            score = query.vectors @ block.vectors[left[part]].T
            # More than k, as the query itself may be among them.
            top = np.partition(np.concatenate([top, score], axis=1), -(k + 1), axis=1)[:, -(k + 1) :]
            kth = np.maximum(kth, top[:, 0])
            parts.append(score)
            at += score.shape[1]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        scores = np.concatenate(parts, axis=1)
        rows, places = np.nonzero(scores >= kth[:, None])
        return rows, left[places], scores[rows, places]

    return visit


def exact_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, pivots: int = 32
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` largest inner products of floor(scale * x) vectors.

    `vectors` and `queries` have vec_id and embedding; a query is not its own candidate; equal
    scores rank by smaller vec_id. Scores are whole numbers and exact while they stay below 2**53.

    Defined cases: vectors that are NULL, empty, or hold a NULL or non-finite component take no part, nor do
    rows without vec_id or vectors of another length than the first by vec_id; fewer than `k`
    candidates give all; of rows that share a query's vec_id the smallest vector is asked and
    none is a candidate for it; rows that share another vec_id are candidates each. No vectors
    give no rows. Other columns are not looked at.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        return rows.select(F.col("vec_id").cast("bigint"), whole.alias("vector"))

    held = prepared(vectors)
    first = held.orderBy("vec_id").select(F.size("vector")).first()
    held = held.where(F.size("vector") == (first[0] if first else 0))
    asked = prepared(queries).where(F.size("vector") == (first[0] if first else 0))
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    # Equal vectors tie everywhere: only the k + 1 smallest ids can rank, one of which may be the query's own.
    # Spark also applies the limit before the shuffle, so a vector that many rows share stays small.
    alike = Window.partitionBy("vector").orderBy("vec_id")
    held = held.withColumn("n", F.dense_rank().over(alike)).where(F.col("n") <= k + 1).select("vec_id", "vector")
    table = choose_pivots(held, pivots)
    found = search(held, asked, table, k, _eliminate(k))
    return found.withColumn("score", F.col("score").cast("bigint"))
