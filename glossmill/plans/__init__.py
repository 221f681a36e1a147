"""Query catalogue of the engine."""

from glossmill.plans import metric_queries, pool_queries, source_queries, text_queries  # noqa: F401
from glossmill.plans.registry import QUERIES, SQL  # noqa: F401
