"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from quarrymill.plans import element_queries, jsonld_queries, log_queries, operations_queries, page_queries, rule_queries, shop_queries, stream_queries, url_queries, workflow_queries  # noqa: F401  (they register themselves)
from quarrymill.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
