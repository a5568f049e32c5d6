"""All registered queries with their SQL."""

from runlens.plans import evidence_queries, rule_queries, source_queries, wait_queries  # noqa: F401  registers their queries
from runlens.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
