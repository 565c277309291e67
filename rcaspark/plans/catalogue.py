"""All registered queries."""

from rcaspark.plans import anomaly_queries, discovery_queries, generation_queries, graph_queries, log_queries, metric_queries, text_queries  # noqa: F401
from rcaspark.plans.registry import ORACLES, QUERIES  # noqa: F401
