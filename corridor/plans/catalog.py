"""All named queries."""

# The modules register their queries when they are imported.
from corridor.plans import geometry_queries, graph_queries, ingest_queries, job_queries, step_queries, trip_queries  # noqa: F401
from corridor.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
