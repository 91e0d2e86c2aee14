"""All queries of the catalogue, by name, and their SQL."""

from __future__ import annotations

from tidewater.plans import core, marts, stream, text  # noqa: F401  they register their queries
from tidewater.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
