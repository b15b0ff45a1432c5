"""The registered queries of the transit engine."""

from __future__ import annotations

from .queries import QUERIES, SQL

FLAGSHIP = "unmapped_schedule"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
