"""Conversations linked by their quotations, in DataFrame operations only.

A line's quote level is the number of '>' it begins with. Lines of one level that follow
one another are a passage; level 0 is what the message itself says. Passages and their
lines are normalised and hashed; a quoted one points to the message that said it first.
A message replies to the message behind its shallowest quotation, the longest one
there; threads follow these links, and keep their messages in reply order without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwright.session import stored

_QUOTE = r"^[ \t]*>"
_PREFIX = r"^((?:[ \t]*>)+)[ \t]?"
_ATTRIBUTION = r"(?i)^\s*(on\b.*)?\bwrote:\s*$"
# Turns that one window task numbers at most, whatever a conversation's length.
TURN_BLOCK = 1024


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 1), "[^>]", ""))


def _content(line: Column) -> Column:
    return F.regexp_replace(line, _PREFIX, "")


def _normal(text: Column) -> Column:
    """A-Z lower-cased, white space as single spaces."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"\s+", " "))


def own_text(text: Column) -> Column:
    """`text` without quoted lines and without 'wrote:' lines right before them."""
    lines = F.split(text, "\n")
    quoted = lambda x: x.rlike(_QUOTE)
    leads = lambda x, i: x.rlike(_ATTRIBUTION) & F.coalesce(quoted(F.get(lines, i + 1)), F.lit(False))
    kept = F.filter(lines, lambda x, i: ~quoted(x) & ~leads(x, i))
    return F.when(text.rlike(r"(?m)" + _QUOTE), F.trim(F.array_join(kept, "\n"))).otherwise(text)


def _passages(rows: DataFrame, text: Column, min_chars: int, *keys: str) -> DataFrame:
    """(*keys, a, b, size) of each distinct line and blank-line-separated part of `text`."""
    lines = F.split(text, "\n")
    parts = F.split(text, r"\n\s*\n")
    pieces = F.array_distinct(F.transform(F.concat(lines, parts, F.array(text)), _normal))
    each = rows.select(*keys, F.explode(pieces).alias("_p")).where(F.length("_p") >= min_chars)
    return each.select(*keys, F.xxhash64("_p").alias("a"), F.xxhash64(F.lit("second"), "_p").alias("b"), F.length("_p").alias("size"))


def quoted_passages(messages: DataFrame, min_chars: int = 1) -> DataFrame:
    """(message, conv_id, turn, level, a, b, size): what each message quotes, by level."""
    quoting = messages.where(F.col("text").rlike(r"(?m)" + _QUOTE))
    lines = quoting.select("message", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("level", _level(F.col("line"))).withColumn("line", _content(F.col("line")))
    order = Window.partitionBy("message").orderBy("line_no")  # the lines of one message
    starts = (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")
    runs = lines.withColumn("run", starts).withColumn("run", F.sum("run").over(order))
    passages = (
        runs.where("level > 0")
        .groupBy("message", "conv_id", "turn", "level", "run")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
        .select("message", "conv_id", "turn", "level", F.array_join("l.line", "\n").alias("text"))
    )
    return _passages(passages, F.col("text"), min_chars, "message", "conv_id", "turn", "level")


def reply_links(messages: DataFrame, min_chars: int = 12) -> DataFrame:
    """(message, to_message): the message each quoting message replies to.

    `messages` has message (a unique number), conv_id, turn, text and own. A passage belongs to
    the first message of the same conversation that says it before the quoting one, else,
    from `min_chars` characters on, to the first of all earlier conversations; earlier means by (conv_id, turn), so links never
    run in a circle.
    """
    quotes = stored(quoted_passages(messages), "quotes")
    wanted = quotes.select("a", "b").distinct()
    said = _passages(messages, F.col("own"), 1, "message", "conv_id", "turn").join(wanted, ["a", "b"], "left_semi")
    place = F.struct("conv_id", "turn", "message").alias("place")
    here = said.groupBy("a", "b", "conv_id").agg(F.min(place).alias("here"))
    first = said.where(F.col("size") >= min_chars).groupBy("a", "b").agg(F.min(place).alias("first"))
    found = quotes.join(here, ["a", "b", "conv_id"], "left").join(first, ["a", "b"], "left")
    now = F.struct("conv_id", "turn")
    earlier = lambda p: F.when(F.struct(p["conv_id"], p["turn"]) < now, p["message"])
    target = F.coalesce(earlier(F.col("here")), earlier(F.col("first")))
    found = found.select("message", "level", "size", target.alias("to_message")).where("to_message is not null")
    best = F.min(F.struct("level", (-F.col("size")).alias("s"), "to_message")).alias("best")
    return found.groupBy("message").agg(best).select("message", F.col("best.to_message").alias("to_message"))


def link_quotations(conversations: DataFrame, min_chars: int = 12) -> DataFrame:
    """Messages as reply-ordered threads without quotes.

    Returns conv_id, turn, role, own_text, parent_conv and parent_turn (of the message replied to
    by quotation, else NULL), depth (links above), thread_conv (conversation of the
    topmost message) and position (from 1, in the order of conv_id and turn within the thread; a
    reply always comes after what it answers). All rows of the input come back.

    Defined cases: NULL and empty texts quote nothing and say nothing (own_text is as given); rows without
    conv_id or turn neither link nor are linked to; rows alike in conv_id and turn are messages
    of their own, ordered by role and text; a message of quotes alone has an empty own_text and keeps its
    place; passages under `min_chars` characters link only inside their conversation; messages without quotes
    stay in their conversation's order; an empty table gives no rows. Other columns are not looked at.
    """
    held = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    # Numbers are given once: the stored table is what is read from here on.
    numbered = stored(held.withColumn("message", F.monotonically_increasing_id()).withColumn("own", own_text(F.col("text"))), "messages")
    placed = numbered.where("conv_id is not null and turn is not null")
    links = stored(reply_links(placed, min_chars), "links")
    # Pointer doubling over the linked messages alone: `top` is a known ancestor, `depth` links above.
    jumps, more = links.withColumn("depth", F.lit(1)).withColumnRenamed("to_message", "top"), not links.isEmpty()
    while more:
        above = jumps.select(F.col("message").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        joined = jumps.join(above, "top", "left")
        jumps = stored(
            joined.select(
                "message", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")
            ),
            "jumps",
        )
        more = not jumps.where("moved").isEmpty()
        jumps = jumps.drop("moved")
    place = lambda prefix: [F.col("message").alias(prefix), F.col("conv_id").alias(f"{prefix}_conv"), F.col("turn").alias(f"{prefix}_turn")]
    parents = links.join(placed.select(*place("to_message")), "to_message").select(
        "message", F.col("to_message_conv").alias("parent_conv"), F.col("to_message_turn").alias("parent_turn")
    )
    tops = jumps.join(placed.select(*place("top")), "top").select("message", "depth", F.col("top_conv").alias("thread_conv"))
    rows = numbered.join(parents, "message", "left").join(tops, "message", "left")
    rows = rows.withColumn("thread_conv", F.coalesce("thread_conv", "conv_id")).withColumn("depth", F.coalesce("depth", F.lit(0)))
    # Positions: a window over bounded blocks of turns, shifted by the sizes of the blocks before.
    rows = stored(rows.withColumn("block", F.floor(F.col("turn") / TURN_BLOCK)), "rows")
    keys = ["thread_conv", "conv_id", "block"]
    before = Window.partitionBy("thread_conv").orderBy("conv_id", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("turn", "role", "text", "message")
    ranked = rows.withColumn("place", F.row_number().over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return ranked.join(sizes, same).select(
        "conv_id", "turn", "role", F.col("own").alias("own_text"), "parent_conv", "parent_turn", "depth", "thread_conv",
        (F.col("start") + F.col("place")).alias("position"),
    )
