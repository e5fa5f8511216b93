"""Expressions over agent names, log lines and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The agent name format and the names of its four parts.
AGENT_PATTERN = r"MCTS-(.*)-(.*)-(.*)-(.*)"
AGENT_PARTS = ("selection", "exploration", "playout", "bounds")


def pattern_group(text: Column, pattern: str, group: int) -> Column:
    """One group of the first match, NULL where the pattern does not match.

    `regexp_extract` gives '' both for no match and for an empty group, so the
    match itself is tested: an empty group stays ''.
    """
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def agent_part(agent: Column, part: str) -> Column:
    """`selection`, `exploration` (float), `playout` or `bounds` of an agent name."""
    value = pattern_group(agent, AGENT_PATTERN, AGENT_PARTS.index(part) + 1)
    return value.try_cast("float") if part == "exploration" else value


def agent_columns(agent: Column, prefix: str) -> dict[str, Column]:
    """The four parts as columns `<prefix>_selection` and so on."""
    return {f"{prefix}_{part}": agent_part(agent, part) for part in AGENT_PARTS}


def pair_columns(first: str = "p1", second: str = "p2") -> dict[str, Column]:
    """Exploration difference and joined names of the two agents' parts."""
    pairs = {
        "exploration_diff": F.col(f"{first}_exploration") - F.col(f"{second}_exploration")
    }
    for part in ("selection", "playout", "bounds"):
        a, b = F.col(f"{first}_{part}"), F.col(f"{second}_{part}")
        pairs[f"{part}_pair"] = F.concat(a, F.lit("-"), b)
    return pairs


def char_count(text: Column) -> Column:
    """Length in code points."""
    return F.length(text)


def tolerant_double(text: Column) -> Column:
    """Number in a string, NULL where it is none."""
    return F.trim(text).try_cast("double")


def recode(value: Column, names: dict, default: Column | None = None) -> Column:
    """Replace listed values, keep the others as strings (or use `default`)."""
    out = None
    for old, new in names.items():
        out = F.when(value == old, new) if out is None else out.when(value == old, new)
    rest = value.cast("string") if default is None else default
    return rest if out is None else out.otherwise(rest)
