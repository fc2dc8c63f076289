"""The registered queries over the driver's tables, each beside its SQL twin."""

from __future__ import annotations

from countloom.plans import audits, counts, feeds, forecasts, readers, robustness, series, statistics  # noqa: F401  each registers its queries
from countloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
