"""Mix sources to target shares by pivotal dependent rounding.

Every source has a target number of words, so every document of it has a wanted
number of copies, target / source size, which is rarely whole. The whole part is
taken; the rest is a copy probability. Two documents with open probabilities at a
time move mass between each other, counted in words and in a random direction,
until one of them is 0 or 1. The words taken stay the same at every step, so a
whole source ends within one document of its target, and a document's expected
number of copies stays what was wanted.

The reduction is a tree: chunks of a source are settled on their own and leave at
most one open document each; those meet in groups of `FAN_IN` chunks, level by
level, until each source has at most one, which a last draw settles. No task sees
more than a chunk, whatever share of the rows a source holds.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.words import word_count
from foldwright.operators.joins import attach_by_group
from foldwright.operators.rowindex import with_row_index
from foldwright.session import scratch_space, stored

# Documents a chunk holds on average, and chunks whose open documents meet.
CHUNK_ROWS = 4_000
FAN_IN = 64
_EPS = 1e-12


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_copies: float = 3.0
) -> DataFrame:
    """(source, source_size, docs, target) from (source, size, ...) rows.

    Sources in code point order, NULL last, get `weights` in turn. Targets share the
    sum of all sizes by weight; one that passes `max_copies` times its source's size
    stops there, and what it leaves is shared by weight among the others, until none
    is above. Without any words every target is 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = with_row_index(totals, [F.col("source").isNull(), F.col("source")], "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stored(
        ranked.withColumn("_weight", F.get(cycle, ((F.col("_rank") - 1) % len(weights)).cast("int"))), "sources"
    )
    top = F.col("source_size") * F.lit(float(max_copies))
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    # Each round one pass over the sources: those above their top at this level stay capped.
    level, capped = 0.0, -1
    while True:
        above = F.col("_weight") * F.lit(level) > top if capped >= 0 else F.lit(False)
        row = ranked.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, top).otherwise(0.0)).alias("spent"),
            F.sum(F.when(~above, F.col("_weight"))).alias("open"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (whole - (row["spent"] or 0.0)) / row["open"]
    target = F.least(top, F.col("_weight") * F.lit(level))
    return ranked.select("source", "source_size", "docs", target.alias("target"))


def _settle(sizes: list[float], open_shares: list[float], draws: list[float]) -> list[float]:
    """Pivotal rounding of one group: all but at most one probability become 0 or 1.

    Moving m words changes a probability by m / size. Of the two ways that end at a
    bound, one is drawn with the chance that keeps both expectations.
    """
    out, held = list(open_shares), -1
    for i, p in enumerate(out):
        if p <= _EPS or p >= 1 - _EPS:
            out[i] = float(round(p))
            continue
        if held < 0:
            held = i
            continue
        q, a, b = out[held], sizes[held], sizes[i]
        up = min((1 - q) * a, p * b)  # words that may move to the held document
        down = min(q * a, (1 - p) * b)  # and from it
        if draws[i] * (up + down) < down:
            q, p = q + up / a, p - up / b
        else:
            q, p = q - down / a, p + down / b
        held_open, own_open = _EPS < q < 1 - _EPS, _EPS < p < 1 - _EPS
        out[held] = q if held_open else float(round(q))
        out[i] = p if own_open else float(round(p))
        if not held_open:
            held = i if own_open else -1
    return out


def _settled(groups: DataFrame, seed: int) -> DataFrame:
    """Settle each chunk of each source, large units first, so that a small one is left open."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_digest"], ascending=[False, True]).reset_index(drop=True)
        draws = [(zlib.crc32(f"{d}|{seed}".encode()) + 0.5) / 4294967296.0 for d in pdf["_digest"]]
        pdf["_p"] = _settle(pdf["size"].astype(float).tolist(), pdf["_p"].tolist(), draws)
        return pdf

    return groups.groupBy("source", "_chunk").applyInPandas(settle, groups.schema)


def _unit_copies(docs: DataFrame, weights: tuple[float, ...], max_copies: float, seed: int) -> DataFrame:
    """(doc_id, source, size, twins, source_size, target, total): copies of all twins together.

    Twins, rows alike in doc_id, source and size, want n times as much as one row: the whole part of
    that is taken, and a single row's probability stays open. So no step moves more than one row.
    """
    with scratch_space(docs.sparkSession):
        sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        units = stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("twins")), "units")
        targets = source_targets(units.withColumn("size", F.col("size") * F.col("twins")), weights, max_copies)
        targets = stored(targets, "targets").withColumnRenamed("source", "_source")
        wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("twins")
        attached = (
            units.join(targets, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("_whole", F.floor(wanted).cast("bigint"))
            .withColumn("_p", wanted - F.col("_whole"))
            .withColumn("_digest", F.md5(F.to_json(F.struct("doc_id", "source", "size", F.lit(seed).alias("seed")))))
            .withColumn("_chunk", F.pmod(F.xxhash64("_digest"), F.ceil(F.col("docs") / CHUNK_ROWS).cast("bigint")))
            .drop("_source")
        )
        is_open = (F.col("_p") > 0) & (F.col("_p") < 1)
        level = stored(_settled(attached.where(F.col("size") > 0), seed), "settled")
        done = [attached.where(F.col("size") == 0).withColumn("_p", F.lit(0.0)), level.where(~is_open)]
        left, step = level.where(is_open), 1
        groups = -(-(targets.agg(F.max("docs")).first()[0] or 0) // CHUNK_ROWS)
        while groups > 1:
            groups, step = -(-groups // FAN_IN), step + 1
            merged = left.withColumn("_chunk", F.floor(F.col("_chunk") / FAN_IN).cast("bigint"))
            level = stored(_settled(merged, seed + step), "settled")
            done.append(level.where(~is_open))
            left = level.where(is_open)
        # At most one open unit a source: a draw decides.
        draw = (F.pmod(F.xxhash64("_digest", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        result = left.withColumn("_p", F.when(draw < F.col("_p"), 1.0).otherwise(0.0))
        for part in done:
            result = result.unionByName(part)
        total = F.col("_whole") + F.col("_p").cast("bigint")
        sizeless = F.when(F.col("size") > 0, total).otherwise(F.lit(0).cast("bigint")).alias("total")
        result = result.select("doc_id", "source", "size", "twins", "source_size", "target", sizeless)
        return stored(result, "mix", keep=True)


def _shared() -> tuple[Column, Column]:
    """What every twin takes, and how many of them take one copy more."""
    more = F.col("total") % F.col("twins")
    return ((F.col("total") - more) / F.col("twins")).cast("bigint"), more


def mix_to_targets(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_copies: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, source, size, twins, source_size, target, copies): how often the mix takes each document.

    `size` counts the words of the whole text, `copies` is whole and at most `max_copies`
    (rounded up where that is not whole). Draws depend on ids, sources, sizes and `seed`
    alone, so reruns agree. Other columns of `docs` are not looked at.

    Defined cases: NULL sources are one source, last in order. NULL, empty and word-free
    texts have size 0 and no copies. Rows alike in doc_id, source and size (also where doc_id
    is NULL) are twins: their copies differ by at most one, and a row of the result stands for
    the `twins` of them that have the same. An empty table gives an empty result.
    """
    units = _unit_copies(docs, weights, max_copies, seed)
    even, more = _shared()
    shares = F.array(
        F.struct((F.col("twins") - more).alias("n"), even.alias("copies")),
        F.struct(more.alias("n"), (even + 1).alias("copies")),
    )
    split = units.withColumn("_share", F.explode(F.filter(shares, lambda s: s["n"] > 0)))
    own = [F.col("_share.n").alias("twins"), "source_size", "target", F.col("_share.copies").alias("copies")]
    return split.select("doc_id", "source", "size", *own)


def mixed_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_copies: float = 3.0,
    seed: int = 7,
) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it is taken; columns as in `docs`.

    Defined cases are those of `mix_to_targets`: rows without words go; of twins, those whose
    texts come first by hash take the copy more that is over; NULL sources and ids match
    themselves; an empty table stays empty. Columns of any name may stand beside the three read.
    """
    keys = ["_id", "_from", "_words"]
    even, more = _shared()
    units = _unit_copies(docs, weights, max_copies, seed).where("total > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("size").alias("_words"),
        "twins", even.alias("_even"), more.alias("_more"),
    )
    # Whole rows in one column: no name of theirs can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("doc_id").alias("_id"), F.col("source").alias("_from"), word_count(F.col("text")).alias("_words"))
    rows = attach_by_group(rows, units, keys, "twins")
    taken = rows.where("_more = 0").select("_row", F.col("_even").alias("_copies"))
    uneven = units.where("_more > 0")
    if not uneven.isEmpty():
        # Twins that cannot share evenly are numbered by one sort of all of them, so no task holds a group.
        order = [*keys, F.xxhash64("_row.text"), F.monotonically_increasing_id()]
        placed = stored(with_row_index(rows.where("_more > 0"), order, "_at"), "twins")
        starts = placed.groupBy(keys).agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("twins"))
        placed = attach_by_group(placed, starts, keys, "twins")
        copies = F.col("_even") + (F.col("_at") - F.col("_start") < F.col("_more")).cast("bigint")
        taken = taken.unionByName(placed.select("_row", copies.alias("_copies")))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return taken.where("_copies > 0").withColumn("_copy", each).select("_row.*")
