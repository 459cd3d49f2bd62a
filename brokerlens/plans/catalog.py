"""All named queries; importing a module registers its queries."""

from __future__ import annotations

from brokerlens.plans import (  # noqa: F401
    q_joins,
    q_learning,
    q_scalars,
    q_sequence,
    q_series,
    q_sources,
    q_streams,
    q_summary,
)
from brokerlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
