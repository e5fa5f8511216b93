"""All registered queries."""

from __future__ import annotations

from foldwright.plans import (  # noqa: F401 - importing registers the queries
    columns,
    folding,
    modelling,
    neighbouring,
    ordering,
    scans,
    scoring,
    summaries,
)
from foldwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
