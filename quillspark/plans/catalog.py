"""The catalogue of queries: importing it registers all of them."""

from __future__ import annotations

from quillspark.plans import article_queries, function_queries, index_queries, lifecycle_queries, link_queries, misc_queries, research_queries, search_queries, source_queries, stat_queries, stream_queries, table_queries  # noqa: F401
from quillspark.plans.registry import oracle_sql, queries  # noqa: F401
