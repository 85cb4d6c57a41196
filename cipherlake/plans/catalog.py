"""All registered queries."""

from cipherlake.plans import queries_features, queries_findings, queries_more  # noqa: F401  (they register their queries)
from cipherlake.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
