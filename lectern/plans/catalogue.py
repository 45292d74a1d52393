"""All queries of the library and, where SQL can express them, their DuckDB statements: importing a module registers its own."""
from __future__ import annotations

from lectern.plans import format_queries, layout_queries, page_queries, quality_queries, record_queries, session_queries, stream_queries, string_queries, term_queries, text_queries, web_queries, work_queries  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES  # noqa: F401
