"""All queries of the engine's own operators, and the SQL that they equal."""

from __future__ import annotations

from . import more_plans, search_plans, store_plans, stream_plans, table_plans, text_plans  # noqa: F401  they register their queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
