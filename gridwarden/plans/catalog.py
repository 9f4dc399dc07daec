"""All registered queries."""

from gridwarden.plans import correlation, detections, expressions, states, streams, tables
from gridwarden.plans.registry import QUERIES, SQL

__all__ = [
    "QUERIES", "SQL", "correlation", "detections", "expressions", "states", "streams", "tables",
]
