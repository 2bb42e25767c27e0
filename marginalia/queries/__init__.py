"""Queries of the library over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from marginalia.queries import landed, logs, matching, pages, plans, report, retrieval, statistics, textual  # noqa: F401
from marginalia.queries.registry import ORACLES, QUERIES
from marginalia.queries.retrieval import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
