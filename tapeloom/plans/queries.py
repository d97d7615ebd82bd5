"""All registered queries."""

from tapeloom.plans import market_queries, series_queries  # noqa: F401  (they register their queries)
from tapeloom.plans.catalog import QUERIES

__all__ = ["QUERIES"]
