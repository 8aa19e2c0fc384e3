"""The registered queries of the library, with their SQL."""

from __future__ import annotations

from .plans import backtests, data, feeds, flows, records, reports, research, rotation, scalars, snapshots, streams, texts  # noqa: F401  each module registers its queries
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
